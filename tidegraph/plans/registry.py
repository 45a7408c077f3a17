"""All registered queries outside ``llm``."""

from tidegraph.plans import checks, core, dealt, vectors

QUERIES = {**core.QUERIES, **vectors.QUERIES, **dealt.QUERIES, **checks.QUERIES}
SQL = {**core.SQL, **vectors.SQL, **dealt.SQL, **checks.SQL}
