"""What the tests share."""

DATA = "/root/testdata/sf0.001"


def same(a, b):
    """Both frames have the same columns and rows, in any order."""
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (a, b))
    assert len(a) == len(b)
    for c in columns:
        if a[c].dtype.kind == "f" or b[c].dtype.kind == "f":
            assert (a[c].astype(float).fillna(-1e99) == b[c].astype(float).fillna(-1e99)).all(), c
        else:
            assert (a[c].astype(str) == b[c].astype(str)).all(), c
