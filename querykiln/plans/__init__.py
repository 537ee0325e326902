"""Registry of queries and their SQL."""

from querykiln.plans import judging, retrieval

QUERIES = {**retrieval.QUERIES, **judging.QUERIES}
ORACLE = {**retrieval.ORACLE, **judging.ORACLE}
