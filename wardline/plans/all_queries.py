"""Every registered query but those over text corpora: name -> (query, SQL or None)."""

from wardline.plans import data_queries, robustness_queries, url_queries

QUERIES = {**url_queries.QUERIES, **data_queries.QUERIES, **robustness_queries.QUERIES}
