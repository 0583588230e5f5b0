def rows(df, *order):
    """All rows as dicts, sorted by the given columns."""
    return [r.asDict() for r in (df.orderBy(*order) if order else df).collect()]


def one(df):
    found = df.collect()
    assert len(found) == 1
    return found[0].asDict()
