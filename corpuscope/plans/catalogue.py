"""All registered queries."""

from corpuscope.plans import audit_queries, business_queries, crawl_queries, output_queries, page_queries, stream_queries

QUERIES = {**page_queries.QUERIES, **crawl_queries.QUERIES, **audit_queries.QUERIES,
           **business_queries.QUERIES, **output_queries.QUERIES, **stream_queries.QUERIES}
