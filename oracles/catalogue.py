"""All check queries."""

from oracles import audit_sql, business_sql, crawl_sql, page_sql

SQL = {**page_sql.SQL, **crawl_sql.SQL, **audit_sql.SQL, **business_sql.SQL}
