"""What turns the rows of a source into the tables of this package, by the name of the source's form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from tidegraph.operators import graph, records

#: Form of a source and the function from its rows (and what else it needs) to a table.
ADAPTERS: dict[str, Callable[..., DataFrame]] = {
    "graph_sheet": graph.sheet_interactions,
    "event_table": graph.event_interactions,
    "text_sheet": records.normalise,
}


def adapter(form: str) -> Callable[..., DataFrame]:
    """The function for a form; an unknown one is an error that names those there are."""
    try:
        return ADAPTERS[form]
    except KeyError:
        raise ValueError(f"no adapter for {form!r}; there are {', '.join(sorted(ADAPTERS))}") from None
