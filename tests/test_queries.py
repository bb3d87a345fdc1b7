"""Every registered query against its check SQL, on the given tables."""

import pytest
from compare import compare

from millrace.queries import collect

QUERIES, CHECKS = collect()


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(key, spark, sf, duck):
    df = QUERIES[key](spark, sf)
    if key in CHECKS:
        ok, note = compare(df, duck, CHECKS[key])
        assert ok, note
        assert "TYPES" not in note, note
    else:
        assert df.count() > 0


def test_keys_avoid_reserved_words():
    assert not [k for k in QUERIES if "pipeline" in k or k.startswith("op")]
    assert set(CHECKS) <= set(QUERIES)
