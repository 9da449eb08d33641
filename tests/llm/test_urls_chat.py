import pytest
from pyspark.sql import functions as F

from riskloom.llm import chat, urls


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(30000).select(F.concat(F.lit("k"), F.col("id")).alias("key"))
    listed = universe.where("crc32(key) % 13 = 0").unionByName(spark.createDataFrame([("outside",), (None,)], "key STRING"))
    cascade = urls.build_cascade(listed, universe.unionByName(universe))
    assert len(cascade.levels) > 2
    wrong = universe.where(cascade.contains(F.col("key")) != F.expr("crc32(key) % 13 = 0"))
    assert wrong.count() == 0
    keys = listed.count()
    assert cascade.n_bytes * 8 < 16 * keys
    with pytest.raises(ValueError):
        urls.build_cascade(listed, universe, max_bytes=100)


def test_empty_lists_and_universes(spark):
    none = spark.createDataFrame([], "key STRING")
    some = spark.createDataFrame([("a",), ("b",), (None,)], "key STRING")
    assert some.where(urls.build_cascade(none, some).contains(F.col("key"))).count() == 0
    assert some.where(urls.build_cascade(some, none).contains(F.col("key"))).count() == 2
    assert some.where(urls.build_cascade(some, some).contains(F.col("key"))).count() == 2


def test_rules_on_odd_urls(spark):
    rules = [urls.UrlRule("allow", "com"), urls.UrlRule("block", "x.com", "/a/"), urls.UrlRule("block", "com"), urls.UrlRule("block", "y.com", "")]
    rows = [None, "", "x.com/a/", "http://X.com/a/b?c#d", "http://www.x.com/A/", "ftp://notx.com/a/", "http://x.com", "http://y.com", "http://com/", "a://.com/", "s://h?x/a"]
    pages = spark.createDataFrame([(u, i, "host") for i, u in enumerate(rows)], "url STRING, _host INT, path STRING")
    got = urls.judge_urls(pages, "url", rules, spark.createDataFrame([("h",)], "host STRING")).toPandas().sort_values("_host")
    assert got["rule"].tolist() == [None, None, None, "x.com/a/", "com/", "com/", None, "y.com", "com/", "com/", None]
    assert got["verdict"].tolist() == ["allow"] * 3 + ["block", "allow", "allow", "allow", "block", "allow", "allow", "block"]
    assert got["host"].tolist()[3] == "x.com" and got["path"].tolist()[4] == "/A/"
    assert urls.judge_urls(pages.limit(0), "url", rules, spark.createDataFrame([], "host STRING")).count() == 0
    assert set(urls.judge_urls(pages, "url", [], spark.createDataFrame([], "host STRING")).toPandas()["verdict"]) == {"allow"}


def test_reply_paths_against_brute_force(spark):
    import random

    rnd = random.Random(5)
    rows, up = [], {}
    for tree in (1, 2, None, 4):
        for n in range(60):
            parent = rnd.choice([None, *range(n)]) if n else None
            if tree == 4:
                parent = n - 1 if n else None  # one deep thread
            rows.append((tree, n, parent, "user", f"t{n}", rnd.choice([None, 1.0, -2.0, 3.0])))
    rows += [(1, 100, 101, "user", "loop", 9.0), (1, 101, 100, "user", "loop", 9.0), (1, 102, 101, "user", "hangs", 9.0), (2, 200, 999, "user", "orphan", 0.0)]
    df = spark.createDataFrame(rows, "tree INT, node INT, parent INT, role STRING, text STRING, score DOUBLE")
    got = chat.reply_paths(df, "score", top=2).toPandas()
    up = {(t, n): p for t, n, p, *_ in rows}
    score = {(t, n): s or 0.0 for t, n, _, _, _, s in rows}
    want = {}
    for t in {r[0] for r in rows}:
        leaves = [n for (x, n) in up if x == t and n not in {p for (y, _), p in up.items() if y == t}]
        best = []
        for leaf in leaves:
            path, at, seen = [leaf], leaf, {leaf}
            while up[t, at] is not None and (t, up[t, at]) in up and up[t, at] not in seen:
                at = up[t, at]
                seen.add(at)
                path.append(at)
            if up[t, at] is None or (t, up[t, at]) not in up:
                best.append((-sum(score[t, n] for n in path), leaf, path[::-1]))
        want[t] = [p for _, _, p in sorted(best)[:2]]
    assert 102 not in set(got["leaf"])
    for t, paths in want.items():
        part = got[got["tree"].isna()] if t is None else got[got["tree"] == t]
        assert [g.sort_values("depth")["node"].tolist() for _, g in part.groupby("rank")] == paths


def test_escapes_come_back_and_hide_control_strings(spark):
    texts = [None, "", "\\", "<\\s>", "<s></s>[INST]\\[/INST]", "<|im_end|>\n\\<|im_start|>", "<<SYS>>\\\\<</SYS>>", "<", "|im_end|>", "a\nb\r$1"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, t STRING")
    got = df.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("back")).toPandas()
    assert got["back"].tolist() == [t or "" for t in texts]
    assert not any(c in e for e in got["e"] for c in chat.CONTROL)


def test_repeated_turns_and_null_roles(spark):
    rows = [(1, 0, None, None, "x"), (1, 1, "assistant", "hi <|im_end|>", "x"), (1, 1, "assistant", "hi <|im_end|>", "x"), (None, 5, "assistant", "only", "x"), (None, None, "user", "", "x")]
    df = spark.createDataFrame(rows, "conv_id INT, turn INT, role STRING, text STRING, formatted STRING")
    out = chat.format_conversations(chat.linear_threads(df, "conv_id", "turn"))
    got = out.select("tree", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    by = {r["tree"]: ([tuple(t) for t in r["turns"]], r["loss"]) for r in got}
    assert by[1] == ([("", ""), ("assistant", "hi <|im_end|>"), ("assistant", "hi <|im_end|>")], "hi <|im_end|>" * 2)
    assert by[None] == ([("user", ""), ("assistant", "only")], "only")
    assert chat.format_conversations(chat.linear_threads(df.limit(0), "conv_id", "turn")).count() == 0


def test_a_comb_lists_its_best_path_alone(spark, monkeypatch):
    """A thread with a leaf at every step has paths of n^2 / 2 rows in all; only the chosen one's are stored."""
    n, stored, keep = 200, [], chat.materialize

    def watched(df, label="stage"):
        out = keep(df, label)
        stored.append((label, out.count()))
        return out

    monkeypatch.setattr(chat, "materialize", watched)
    rows = [(1, i, i - 1 if i else None, 1.0) for i in range(n)] + [(1, 1000 + i, i, 0.5 if i == 150 else -float(i)) for i in range(n)]
    got = chat.reply_paths(spark.createDataFrame(rows, "tree INT, node INT, parent INT, score DOUBLE"), "score").toPandas().sort_values("depth")
    assert got["node"].tolist() == [*range(151), 1150] and got["depth"].tolist() == list(range(152))
    assert set(got["leaf"]) == {1150} and set(got["path_score"]) == {151.5}
    assert max(k for label, k in stored if label == "paths") == 152 and all(k <= 2 * n for _, k in stored)
