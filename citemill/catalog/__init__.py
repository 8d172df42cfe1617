"""Named queries over the given tables, each with the SQL that checks it.

The corpus tables stand in for filings: a document's id is its accession
number, its language the section and its source the company.
"""

from citemill.catalog import answers, checks, search, store, texts  # noqa: F401
from citemill.catalog.registry import ORACLES, QUERIES  # noqa: F401
