"""Digests of files in ordered pieces: equal for all split sizes, equal to a plain tree."""

import hashlib

from tallyfold.sources.file_digest import file_digests


def H(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain(lines, leaf):
    level = [H("\n".join(lines[i : i + leaf])) for i in range(0, len(lines), leaf)] or [H("")]
    while len(level) > 1:
        level = [H("".join(level[i : i + 8])) for i in range(0, len(level), 8)]
    return level[0]


def test_digest_is_the_same_for_every_split_size(spark, tmp_path):
    big = [f"line {i} " + "x" * (i % 97) + ("é" if i % 5 == 0 else "") for i in range(30_000)]
    small = ["a", "", "b"]
    (tmp_path / "big.txt").write_text("\n".join(big) + "\n")
    (tmp_path / "small.txt").write_text("\r\n".join(small))
    (tmp_path / "empty.txt").write_text("")
    paths = [str(tmp_path / n) for n in ("big.txt", "small.txt", "empty.txt")]
    seen = []
    for split in ("4k", "64k", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        got = file_digests(spark, paths, leaf_lines=512)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "content" not in plan
        seen.append({r["path"].rsplit("/", 1)[-1]: (r["file_hash"], r["n_lines"]) for r in got.collect()})
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")
    assert seen[0] == seen[1] == seen[2]
    assert seen[0]["big.txt"] == (plain(big, 512), 30_000)
    assert seen[0]["small.txt"] == (plain(small, 512), 3)
    # Spark's file readers list no empty file; uploads never held them either.
    assert "empty.txt" not in seen[0]
