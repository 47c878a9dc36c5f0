"""Secret scan over a trigram inverted index, with DataFrame functions only.

From each rule's regular expression a Boolean query over trigrams is derived (an OR of ANDs that every match implies). A
posting (trigram, document) is written for every trigram that some rule asks for; postings are intersected by document, and
only documents that satisfy a rule's query are verified with the rule's expression. A rule without a mandatory trigram
scans every text. Texts are lower-cased for the index, so postings are a superset for rules of either case. A bit table of
fixed size tells which documents may be candidates, so that the others are never moved.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _constants as C
from re import _parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultspark.llm.common import stored, table

#: A set of alternatives is followed literally up to this many strings; beyond that it counts as unknown.
MOST_STRINGS = 64
#: Bits that mark candidates; matches that are placed together; characters of a chunk in which places are looked up.
FILTER_BITS, BLOCK, CHUNK = 1 << 23, 256, 4096


@dataclass(frozen=True)
class Rule:
    """pattern: for Java and Python alike; a match counts if `group` has at least `least` characters."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0


#: The three base kinds, in the order in which they are listed.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]+", 32),
)
#: What the method adds.
ADDED = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{16,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + ADDED


def trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """An OR of ANDs of lower-case trigrams that every match of the pattern satisfies; None if no trigram is mandatory."""
    found: list[list[frozenset[str]]] = []

    def flush(strings: set[str]) -> None:
        sets = {trigrams(s) for s in strings}
        if sets and all(sets):
            found.append([s for s in sets if not any(o < s for o in sets)])

    def alternatives(op, arg) -> set[str] | None:
        """The exact strings of a node, or None."""
        if op is C.LITERAL:
            return {chr(arg).lower()}
        if op is C.IN and all(o is C.LITERAL for o, _ in arg):
            return {chr(a).lower() for _, a in arg}
        if op is C.BRANCH:
            parts = [exact(b) for b in arg[1]]
            return None if None in parts else set().union(*parts)
        if op is C.SUBPATTERN:
            return exact(arg[3])
        if op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[:2] == (0, 1) and (inner := exact(arg[2])) is not None:
            return inner | {""}
        if op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] == arg[1] and (inner := exact(arg[2])) is not None and len(inner) == 1:
            return {next(iter(inner)) * arg[0]} if arg[0] <= MOST_STRINGS else None
        return None

    def exact(nodes) -> set[str] | None:
        strings = {""}
        for op, arg in nodes:
            more = alternatives(op, arg)
            if more is None or len(strings) * len(more) > MOST_STRINGS:
                return None
            strings = {a + b for a, b in product(strings, more)}
        return strings

    def walk(nodes) -> None:
        strings = {""}
        for op, arg in nodes:
            more = alternatives(op, arg)
            if more is not None and len(strings) * len(more) <= MOST_STRINGS:
                strings = {a + b for a, b in product(strings, more)}
                continue
            flush(strings)
            strings = {""} if more is None else more
            if more is None and op is C.SUBPATTERN:
                walk(arg[3])
            elif more is None and op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] >= 1:
                walk(arg[2])
        flush(strings)

    walk(_parser.parse(pattern))
    # the groups hold together; one with few alternatives and many trigrams prunes best
    return min(found, key=lambda g: (len(g), -min(map(len, g)))) if found else None


def _has(text: Column, rules: tuple[Rule, ...]) -> list[tuple[str, Column]]:
    needed = sorted({t for r in rules for conj in trigram_query(r.pattern) or [] for t in conj})
    return [(t, F.contains(text, F.lit(t))) for t in needed]


def trigram_postings(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The inverted index of docs (key, text): one row (trigram, key) per trigram of the rules' queries and document that holds
    it, sorted by trigram within each file."""
    present = F.array_compact(F.array(*[F.when(has, F.lit(t)) for t, has in _has(F.col("low"), rules)]))
    low = docs.select("key", F.lower("text").alias("low"))
    return low.select("key", F.explode(present).alias("trigram")).select("trigram", "key").sortWithinPartitions("trigram")


def candidates(postings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Postings intersected: one row per key with the kinds whose trigram query it satisfies. A document has at most as
    many postings as the rules have trigrams, so no group grows with the corpus."""
    held = postings.groupBy("key").agg(F.collect_set("trigram").alias("held"))
    kinds = []
    for r in rules:
        if query := trigram_query(r.pattern):
            met = [F.size(F.array_except(F.array(*map(F.lit, sorted(conj))), "held")) == 0 for conj in query]
            kinds.append(F.when(F.array_max(F.array(*met)), F.lit(r.kind)))
    return held.select("key", F.array_compact(F.array(*kinds)).alias("kinds")).filter(F.size("kinds") > 0)


def marked(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows (key and others) with `maybe`: false only if found has no such key. The keys of found set bits in a table of at most
    FILTER_BITS / 64 words, however many they are; that table alone is broadcast."""
    bit = F.pmod("key", F.lit(FILTER_BITS))
    word, mask = F.shiftright(bit, 6).alias("word"), F.expr(f"shiftleft(1L, int(pmod(key, {FILTER_BITS}) & 63))")
    words = found.select(word, mask.alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask"))
    joined = rows.select("*", word).join(F.broadcast(words), "word", "left")
    return joined.select(*rows.columns, F.coalesce(F.col("mask").bitwiseAND(mask) != 0, F.lit(False)).alias("maybe"))


def let(value: Column, body) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, combine) -> Column:
    """For each number of an array (a column or a lambda's variable) what those before it combine to, by an associative operation
    with neutral element 0. Done in blocks, and first over the blocks' totals, so that growing arrays stay short whatever the
    number of values."""
    last = F.floor((F.size(values) - 1) / BLOCK).cast("int")
    blocks = F.when(F.size(values) > 0, F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(values, b * BLOCK + 1, BLOCK)))

    def before(array: Column, start: Column) -> Column:
        step = lambda acc, v: F.struct(combine(acc["now"], v).alias("now"), F.array_append(acc["out"], acc["now"]).alias("out"))
        return F.aggregate(array, F.struct(start.alias("now"), F.array().cast("array<int>").alias("out")), step)["out"]

    total = lambda b: F.aggregate(b, F.lit(0), combine)
    return let(blocks, lambda bs: F.flatten(F.zip_with(bs, before(F.transform(bs, total), F.lit(0)), before)))


def _shortest(rule: Rule) -> str:
    """The rule's pattern; of a run of one class, the same matches without those that are too short."""
    run = rule.group == 0 and rule.least > 1 and rule.pattern.startswith("[") and rule.pattern.endswith("]+")
    return f"{rule.pattern[:-1]}{{{rule.least},}}" if run else rule.pattern


def _matches(text: Column, rule: Rule, no: int) -> Column:
    """A rule's matches, each with the gap before it: their lengths, and whether the match is long enough."""

    def pair(m: Column, g: Column) -> Column:
        value = F.regexp_extract(m, rule.pattern, rule.group) if rule.group else m
        return F.struct(F.length(g).alias("gap"), F.length(m).alias("size"), (F.length(value) >= rule.least).alias("ok"))

    gaps = F.split(text, _shortest(rule), -1)
    pairs = let(F.regexp_extract_all(text, F.lit(_shortest(rule)), F.lit(0)), lambda hits: F.zip_with(hits, F.slice(gaps, 1, F.size(hits)), pair))
    return F.struct(F.lit(no).alias("kind_no"), F.lit(rule.kind).alias("kind"), pairs.alias("pairs"))


def rule_spans(text: Column, on: list[Column], rules: tuple[Rule, ...]) -> Column:
    """array<struct<start, kind_no, kind, end>> of each rule's matches where its condition holds, in code points, end exclusive,
    sorted. Matches and the gaps between them alternate, so running lengths give the places."""
    found = F.array_compact(F.array(*[F.when(c, _matches(text, r, i)) for i, (c, r) in enumerate(zip(on, rules))]))

    def placed(rule: Column) -> Column:
        def place(p: Column, at: Column) -> Column:
            span = F.struct((at + p["gap"]).alias("start"), rule["kind_no"].alias("kind_no"), rule["kind"].alias("kind"), (at + p["gap"] + p["size"]).alias("end"))
            return F.when(p["ok"], span)

        sizes = F.transform(rule["pairs"], lambda p: p["gap"] + p["size"])
        return let(sizes, lambda x: F.array_compact(F.zip_with(rule["pairs"], running(x, lambda a, b: a + b), place)))

    return F.array_sort(F.flatten(F.transform(F.filter(found, lambda rule: F.size(rule["pairs"]) > 0), placed)))


def _spanned(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """row (the caller's), text and spans."""
    rows = docs.select(F.xxhash64("doc_id", "text").alias("key"), "text", F.struct("*").alias("row"))
    index = stored(trigram_postings(rows, rules), "trigram-postings")
    found = stored(candidates(index, rules), "trigram-candidates")
    told = marked(rows, found)
    # only documents that may be candidates are moved to meet their kinds, by one plan at every size
    some = told.filter("maybe").join(found.hint("merge"), "key", "left").select("text", "row", "kinds")
    rest = told.filter("NOT maybe").select("text", "row", F.lit(None).cast("array<string>").alias("kinds"))
    on = []
    for r in rules:
        if trigram_query(r.pattern):
            on.append(F.array_contains("kinds", r.kind))
        else:  # no mandatory trigram: every text is scanned, where it is
            on.append(F.col("text").rlike(_shortest(r)))
    return some.unionByName(rest).select("row", "text", rule_spans(F.col("text"), on, rules).alias("spans"))


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, out: str = "spans") -> DataFrame:
    """docs with `spans` (or as `out` names it), array<struct<start, kind_no, kind, end>> sorted by start, then by kind as listed.

    docs needs doc_id and text; a column of its own with that name is replaced, others stay, whatever their names. Null and
    empty texts have no spans. Rows are told apart by a hash of doc_id and text; rows that share it share candidate kinds and
    are verified each on their own text, so results are exact and no row is lost or doubled. An empty table gives an empty
    result.
    """
    return _spanned(docs.drop(out), rules).select("row.*", F.col("spans").alias(out))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of find_secrets in text replaced by mark; spans that overlap become one mark. n_chars, if
    there, follows the text. No row goes, and no other column changes."""
    hit = F.size("spans") > 0
    chunks = F.when(hit, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)))  # places are found in a chunk, not from the text's start

    def piece(a: Column, b: Column) -> Column:
        """The characters a to b - 1."""
        first, last = F.floor(a / CHUNK).cast("int"), F.floor(b / CHUNK).cast("int")
        head, tail = F.substring(F.get("chunks", first), a % CHUNK + 1, F.lit(CHUNK)), F.substring(F.get("chunks", last), F.lit(1), b % CHUNK)
        several = F.concat(head, F.array_join(F.slice("chunks", first + 2, last - first - 1), ""), F.coalesce(tail, F.lit("")))
        return F.coalesce(F.when(first == last, F.substring(F.get("chunks", first), a % CHUNK + 1, b - a)).otherwise(several), F.lit(""))

    found = _spanned(docs, rules).select("row", "text", "spans", chunks.alias("chunks"), F.when(hit, F.transform("spans", lambda s: s["end"])).alias("done"))
    before = running(F.col("done"), lambda a, b: F.greatest(a, b))
    parts = F.zip_with(F.col("spans"), before, lambda s, before: F.when(s["start"] >= before, F.concat(piece(before, s["start"]), F.lit(mark))).otherwise(F.lit("")))
    clean = F.when(hit, F.concat(F.array_join(parts, ""), let(F.array_max("done"), lambda last: piece(last, F.length("text"))))).otherwise(F.col("text"))
    found = found.select("row", hit.alias("hit"), clean.alias("text"))
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("hit"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return found.select(*[changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    join = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = join(F.filter("spans", lambda s: s["kind_no"] < len(BASE)))
    return found.select("doc_id", *[count(r.kind) for r in BASE], F.sha2(base.cast("binary"), 256).alias("base_sha256"), join(F.col("spans")).alias("spans"))
