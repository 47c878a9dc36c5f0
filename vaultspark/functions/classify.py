"""Labels from ranges, shares and codes."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column
from pyspark.sql import functions as F

from vaultspark.config import UNKNOWN


def threshold_class(value: Column, bands, gapless: bool = False, unknown: str = UNKNOWN) -> Column:
    """The label of the first (label, low, high) with low <= value <= high, else unknown; so a value between two whole
    bounds has none. gapless: a band reaches up to its high from the last one's, and from the first low."""
    out, first = F.lit(unknown), bands[0][1]
    for label, low, high in reversed(bands):
        inside = value <= high if gapless else value.between(low, high)
        out = F.when(inside, label).otherwise(out)
    return F.when(value >= first, out).otherwise(unknown) if gapless else out


def share_class(value: Column, labels, shares) -> Column:
    """The label whose share of 0 to sum(shares) - 1 the value falls into: below the first cumulated share the first, and so
    on, the last one for everything above."""
    out = F.lit(labels[-1])
    for label, bound in reversed([*zip(labels, accumulate(shares))][:-1]):
        out = F.when(value < bound, label).otherwise(out)
    return out


def channel_class(kind: Column, channel: Column, withdrawal: str = "DATM", deposit: str = "CATM", atm: str = "ATM") -> Column:
    return F.when(kind == withdrawal, "RETIRO_ATM").when(kind == deposit, "DEPOSITO_ATM").when(channel == atm, "OTRA_OP_ATM").otherwise("NO_ATM")
