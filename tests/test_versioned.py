"""Versioned tables: failures before the commit, two writers, old versions."""

import pytest

from turnlens.operators import facts, versioned

SCHEMA = "provider string, provider_session_id string, cost double"


def batch(spark, *rows):
    return spark.createDataFrame(rows, SCHEMA)


def held(spark, root, version=None):
    return sorted(map(tuple, versioned.load(spark, root, SCHEMA, version).collect()), key=str)


def write(root, rows, **more):
    return versioned.upsert(root, rows, facts.SESSION_KEY, "provider", **more)


def test_upserts_replace_keys_and_repeat(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    assert held(spark, root) == []
    one = batch(spark, ("p", "1", 1.0), ("p", "2", 2.0), ("q/x y", "1", 3.0), (None, "9", 0.5))
    assert write(root, one) == 1
    assert write(root, batch(spark, ("p", "2", 5.0), ("r", "1", 6.0))) == 2
    want = [("p", "1", 1.0), ("p", "2", 5.0), ("q/x y", "1", 3.0), (None, "9", 0.5), ("r", "1", 6.0)]
    assert held(spark, root) == sorted(want, key=str)
    write(root, batch(spark, ("p", "2", 5.0), ("r", "1", 6.0)))
    assert held(spark, root) == sorted(want, key=str)
    assert held(spark, root, 1) == sorted(map(tuple, one.collect()), key=str)


def test_a_failure_before_the_commit_changes_nothing(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    write(root, batch(spark, ("p", "1", 1.0)))

    def fail():
        raise OSError("no room")

    with pytest.raises(OSError, match="no room"):
        write(root, batch(spark, ("p", "1", 9.0), ("q", "1", 9.0)), before_commit=fail)
    assert held(spark, root) == [("p", "1", 1.0)]
    write(root, batch(spark, ("q", "1", 2.0)))
    assert held(spark, root) == [("p", "1", 1.0), ("q", "1", 2.0)]


def test_of_two_writers_none_is_lost(spark, tmp_path):
    """A second writer commits while the first is about to: the first merges again with what the second wrote."""
    root = f"file://{tmp_path}/t"
    write(root, batch(spark, ("p", "1", 1.0), ("p", "2", 1.0)))
    others = [("p", "2", 7.0)]

    def meanwhile():
        if others:
            write(root, batch(spark, others.pop()))

    assert write(root, batch(spark, ("p", "1", 8.0), ("p", "3", 8.0)), before_commit=meanwhile) == 3
    assert held(spark, root) == [("p", "1", 8.0), ("p", "2", 7.0), ("p", "3", 8.0)]


def test_sweeping_keeps_what_is_named(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    for k in range(4):
        write(root, batch(spark, ("p", "1", float(k)), (f"q{k}", "1", 1.0)))
    now = held(spark, root)
    assert versioned.sweep(spark, root, keep=2) == []  # all are young
    gone = versioned.sweep(spark, root, keep=1, older_than_ms=0)
    assert len(gone) == 3 and held(spark, root) == now
    with pytest.raises(Exception, match="does not exist|FileNotFound"):
        held(spark, root, 1)
