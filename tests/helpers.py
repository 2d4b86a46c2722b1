def column(df, name):
    """The values of a column, in the order of the rows."""
    return [r[name] for r in df.select(name).collect()]


def as_dict(df):
    """A two-column frame as a dict."""
    return {r[0]: r[1] for r in df.collect()}
