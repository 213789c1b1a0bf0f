"""Helpers shared by the tests."""


def rows(df, *cols):
    """Sorted tuples of a DataFrame."""
    picked = df.select(*cols) if cols else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)
