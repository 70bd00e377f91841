"""Training-data operators for large text corpora (language-model scoring,
line and document dedup, fingerprints, packing, mixing, quality, WARC,
sharding). Nothing else in the library imports this subpackage."""
