"""Snapshots of a dataset: what each change leaves, racing writers, and what stays where it is."""

import threading

import pytest

from tunelake import schemas
from tunelake.sources import versions


def rows(spark, names):
    return spark.createDataFrame([(n, 1, i, f"p{n}", "r", 9.0, "s", None) for i, n in enumerate(names)],
                                 "example_id string, batch_id long, seq long, prompt string, response string, "
                                 "score double, source string, issue string")


def requests(spark, names, prompt="p"):
    return spark.createDataFrame([(n, f"{prompt}{n}") for n in names], "example_id string, prompt string")


def ids(spark, shot):
    return sorted(r["example_id"] for r in shot.examples(spark).collect())


def test_changes_make_versions(spark, tmp_path):
    root = str(tmp_path / "set")
    assert versions.snapshot(spark, root).version == 0 and ids(spark, versions.snapshot(spark, root)) == []
    first = versions.append(versions.snapshot(spark, root), rows(spark, "abc"))
    second = versions.append(first, rows(spark, "de"))
    third = versions.delete(second, requests(spark, "ax"))
    assert (ids(spark, third), third.version) == (["b", "c", "d", "e"], 3)
    assert third.parts[0] == second.parts[1] and len(third.parts) == 2
    assert versions.delete(third, requests(spark, "b", prompt="other ")) is third
    cleared = versions.clear(spark, third)
    assert versions.snapshot(spark, root) == cleared and ids(spark, cleared) == []
    again = versions.append(cleared, rows(spark, "z"))
    assert [tuple(r) for r in versions.history(spark, root).orderBy("version").collect()] == [
        (1, "append", 1), (2, "append", 2), (3, "delete", 2), (4, "clear", 0), (5, "append", 1)]
    assert [ids(spark, versions.snapshot(spark, root, v)) for v in (1, 2, 5)] == [list("abc"), list("abcde"), ["z"]]
    with pytest.raises(ValueError):
        versions.snapshot(spark, root, 6)
    dropped = versions.vacuum(spark, root, keep_versions=1)
    assert len(dropped) == 3 and versions.versions(spark, root) == [5] and ids(spark, again) == ["z"]


def test_of_two_writers_one_wins(spark, tmp_path):
    root = str(tmp_path / "set")
    base = versions.append(versions.snapshot(spark, root), rows(spark, "ab"))
    winner = versions.delete(base, requests(spark, "a"))
    with pytest.raises(versions.Conflict):
        versions.append(base, rows(spark, "c"))
    assert versions.snapshot(spark, root) == winner
    done = versions.change(spark, root, lambda now: versions.append(now, rows(spark, "c")))
    assert ids(spark, done) == ["b", "c"]


def test_racing_writers_lose_nothing(spark, tmp_path):
    root = str(tmp_path / "set")
    barrier, failed = threading.Barrier(4), []

    def write(name):
        more = rows(spark, [name])
        barrier.wait()
        try:
            versions.change(spark, root, lambda now: versions.append(now, more))
        except Exception as error:
            failed.append(error)

    writers = [threading.Thread(target=write, args=(name,)) for name in "abcd"]
    for writer in writers:
        writer.start()
    for writer in writers:
        writer.join()
    assert not failed and ids(spark, versions.snapshot(spark, root)) == list("abcd")
    assert versions.versions(spark, root) == [1, 2, 3, 4]


def test_first_schema_holds(spark, tmp_path):
    root = str(tmp_path / "set")
    first = versions.append(versions.snapshot(spark, root), rows(spark, "a"))
    wider = rows(spark, "b").selectExpr("*", "'x' AS extra", "1 AS _more")
    second = versions.append(first, wider)
    assert second.examples(spark).columns == rows(spark, "a").columns and ids(spark, second) == ["a", "b"]
    assert {name.split()[0] for name in schemas.EXAMPLE.split(", ")} >= {"example_id", "prompt"}
