"""Training-data operators (language ID, dedup, packing, search, ...). Nothing outside this subpackage imports it."""
