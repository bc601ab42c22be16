"""The queries of the training-data operators, with their SQL where SQL can express them."""

from scriptorium.llm import bpe, decontaminate, hosts, html, media, neardup, order, quality, search, secrets, sharding, warc, whiten

MODULES = [bpe, decontaminate, html, media, neardup, order, quality, sharding, secrets, warc, search, whiten, hosts]
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in MODULES for name, sql in module.SQL.items()}
