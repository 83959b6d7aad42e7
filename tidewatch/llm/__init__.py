"""Training-data operators: deduplication, fingerprints, mixing, quality, URLs, BPE, language, WARC and HTML.

Each module holds one operator with its general interface; ``queries`` derives the registered queries from them.
Nothing else in the library imports this subpackage.
"""
