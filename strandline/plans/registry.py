"""All queries of the library by name, and their SQL."""

from strandline.plans import forms, graphs, lineage, problems  # noqa: F401  forms and graphs add theirs to those of lineage

QUERIES = {**problems.QUERIES, **lineage.QUERIES}
SQL = {**problems.SQL, **lineage.SQL}
