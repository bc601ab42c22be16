"""All queries of the archive engine by name, and the SQL each is held against."""

from scriptorium.plans import archive, catalogue, payloads, quality, records, site, states, texts

MODULES = [catalogue, records, texts, quality, archive, payloads, states, site]
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in MODULES for name, sql in module.SQL.items()}
