"""Parameters from a file and from the session."""

from __future__ import annotations

import json

import pytest

from helixplan.params import PREFIX, AssemblyParams


def test_file_and_session(spark, tmp_path):
    path = tmp_path / "params.json"
    path.write_text(json.dumps({"k": 25, "min_count": "4", "with_prefix": True, "take_first": None}))
    assert AssemblyParams.load(spark, str(path)) == AssemblyParams(k=25, min_count=4, with_prefix=True)
    assert AssemblyParams.load(spark) == AssemblyParams()
    spark.conf.set(PREFIX + "k", "31")
    spark.conf.set(PREFIX + "canonical_only", "true")
    try:
        assert AssemblyParams.load(spark, str(path)) == AssemblyParams(k=31, min_count=4, with_prefix=True, canonical_only=True)
    finally:
        spark.conf.unset(PREFIX + "k")
        spark.conf.unset(PREFIX + "canonical_only")


@pytest.mark.parametrize("told", [{"kk": 3}, {"k": "many"}, {"k": True}, {"k": 0}, {"with_prefix": 1}, {"low": 9, "high": 3}, {"k": None}])
def test_bad_values(told):
    with pytest.raises(ValueError):
        AssemblyParams.of(told)
