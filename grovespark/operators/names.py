"""Names for columns of the work's own, apart from those of a table."""

from pyspark.sql import DataFrame


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has, whatever their case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        own = f"_{name}"
        while own.lower() in taken:
            own = f"_{own}"
        out.append(own)
    return out
