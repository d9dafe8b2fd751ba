"""Training-data operators: sharding, packing, dedup, extraction, language
identification, tokenisation and URL filtering.  Nothing outside this
subpackage imports it."""
