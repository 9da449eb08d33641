import numpy as np
from llm_words import words

from riskloom.llm import packing, queries, tokenshards


def check_bins(rows, longest=4096):
    """No bin overflows or overlaps, each has the least capacity that holds it."""
    for _, part in rows.groupby("bin"):
        part = part.sort_values("bin_offset")
        ends = (part["bin_offset"] + part["length"]).tolist()
        assert part["bin_offset"].tolist() == [0, *ends[:-1]] and part["capacity"].nunique() == 1
        assert part["capacity"].iloc[0] == min(c for c in packing.CAPACITIES if c >= ends[-1])


def test_packing_against_a_plain_best_fit():
    rng = np.random.default_rng(1)
    for caps in ((10,), (4, 10, 16)):
        for _ in range(30):
            lengths = rng.integers(0, max(caps) + 1, 60)
            bins, offsets, capacity = packing.pack(lengths, caps)
            held = np.bincount(bins[bins >= 0], weights=lengths[bins >= 0])
            assert (held <= max(caps)).all() and (bins[lengths == 0] == -1).all()
            for b, n in enumerate(held):
                assert set(capacity[bins == b]) == {min(c for c in caps if c >= n)}
        if len(caps) == 1:  # one capacity: plain best-fit decreasing, searched step by step
            rooms = []
            for n in sorted((int(x) for x in lengths if x), reverse=True):
                fit = [i for i, r in enumerate(rooms) if r >= n]
                if fit:
                    i = min(fit, key=lambda i: rooms[i])
                    rooms[i] -= n
                else:
                    rooms.append(10 - n)
            assert len(rooms) == len(held)


def test_small_bins_are_opened_when_they_cost_less():
    bins, _, capacity = packing.pack([9, 9, 9], (10, 100), cost=lambda c: c)
    assert set(capacity) == {10} and len(set(bins)) == 3  # 30 tokens against 100
    bins, _, capacity = packing.pack([9, 9, 9], (10, 100))
    assert set(capacity) == {100} and len(set(bins)) == 1  # with the share of each bin, 164 against 222
    bins, _, capacity = packing.pack([60, 9], (10, 100))
    assert capacity.tolist() == [100, 100] and bins.tolist() == [0, 0]


def test_packing_query_covers_all_texts(spark, sf):
    got = queries.QUERIES["op6_best_fit_packing"](spark, sf).toPandas()
    check_bins(got)
    docs = {r["doc_id"]: len(words(r["text"])) + 1 for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert got.groupby("doc_id")["length"].sum().to_dict() == docs
    assert got.drop_duplicates("bin")["capacity"].sum() < 1.1 * sum(docs.values())


def test_pieces_of_odd_rows_add_up(odd_docs, no_docs):
    got = packing.pack_documents(odd_docs, keep=("doc_id", "source"), with_text=True).toPandas()
    check_bins(got)
    for r in odd_docs.collect():
        mine = got[got["doc_id"].isna()] if r["doc_id"] is None else got[got["doc_id"] == r["doc_id"]]
        times = 2 if r["doc_id"] == 5 else 1
        joined = "".join(mine.sort_values(["piece"])["piece_text"].iloc[::times])
        assert joined == (r["text"] or "") and mine["length"].sum() == times * (len(words(r["text"])) + 1)
    assert packing.pack_documents(no_docs).count() == 0


def test_repeated_rows_are_dealt_apart(spark):
    rows = [(None, "")] * 2000 + [(7, None)] * 1000 + [(i, "a b") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING").repartition(3)
    got = packing.pack_documents(docs, rows_per_bucket=100).toPandas()
    assert len(got) == len(rows) and got["doc_id"].isna().sum() == 2000 and (got["doc_id"] == 7).sum() == 1001
    check_bins(got)
    assert (got["bin"] // (1 << 32)).value_counts().max() < 200
    assert packing._repeats_apart([5, 5, 6], 0, packing.defaultdict(int))[::2] == [5, 6]
    one, other = (packing._repeats_apart(x, 3, packing.defaultdict(int)) for x in ([5, 5, 6, 5], [6, 5, 5, 5]))
    assert sorted(one) == sorted(other) and len(set(one)) == 4


def test_permutation_is_one(spark):
    for n in (0, 1, 2, 3, 5, 64, 1000, 4097):
        assert sorted(tokenshards.permuted(np.arange(n), n, 7).tolist()) == list(range(n))
    a, b = tokenshards.permuted(np.arange(1000), 1000, 7), tokenshards.permuted(np.arange(1000), 1000, 8)
    assert (a != b).mean() > 0.9 and abs(np.corrcoef(np.arange(1000), a)[0, 1]) < 0.15


def test_tokens_decode_to_the_text(odd_docs):
    encode = tokenshards.Encoder(tokenshards.VOCABULARY)
    for t in [r["text"] or "" for r in odd_docs.collect()] + ["a  b", "a \n b\n\nc \t d", "it's 12 34!? '", "\u00a0 \u00a0x \u2003 y"]:
        tokens = np.frombuffer(encode(t), "<u2").tolist()
        assert encode.bpe.decode(tokens) == t and len(tokens) <= len(t.encode()) and tokenshards.END not in tokens


def test_shards_hold_every_sequence_once(spark, odd_docs, tmp_path):
    path, out = f"{tmp_path}/docs", f"{tmp_path}/shards"
    odd_docs.repartition(3).write.parquet(path)
    rows = tokenshards.write_training_order(path, out, spark, stride=16, shard_bytes=16 * 2 * 100).toPandas()
    stored = tokenshards.read_training_order(spark, out, 16).toPandas().set_index("slot")["tokens"]
    total = len(rows)
    assert sorted(rows["slot"]) == list(range(total)) == sorted(stored.index)
    sizes = rows.groupby("shard").size()
    assert len(sizes) > 3 and sizes.max() <= 100 and (rows.sort_values("slot")["shard"].diff().dropna() >= 0).all()
    encode, want = tokenshards.Encoder(tokenshards.VOCABULARY), []
    end = np.array([tokenshards.END], "<u2").tobytes()
    for r in odd_docs.collect():
        raw = encode(r["text"] or "") + end
        for seq, a in enumerate(range(0, len(raw), 32)):
            want.append((-1 if r["doc_id"] is None else r["doc_id"], seq, raw[a:a + 32] + end * (16 - len(raw[a:a + 32]) // 2)))
    got = [(-1 if np.isnan(r["id"]) else int(r["id"]), int(r["seq"]), bytes(stored[r["slot"]])) for _, r in rows.iterrows()]
    assert sorted(got) == sorted(want)
    resumed = tokenshards.read_training_order(spark, out, 16, first_slot=total // 2).toPandas()
    assert sorted(resumed["slot"]) == list(range(total // 2, total))


def test_slots_follow_the_images(spark, tmp_path):
    """The order by brute force, with several shards for each task and repeated rows."""
    path, out = f"{tmp_path}/docs", f"{tmp_path}/shards"
    rows = [(i % 700, "word " * (i % 13)) for i in range(900)] + [(5, "same text")] * 200
    spark.createDataFrame(rows, "doc_id LONG, text STRING").repartition(5).write.parquet(path)
    got = tokenshards.write_training_order(path, out, spark, stride=8, shard_bytes=8 * 2 * 10, key=99).toPandas()
    stored = tokenshards.read_training_order(spark, out, 8).toPandas().set_index("slot")["tokens"]
    read = spark.read.parquet(path).select("doc_id", "text", "_metadata.file_path", "_metadata.row_index").toPandas()
    encode, end, number, used = tokenshards.Encoder(tokenshards.VOCABULARY), np.array([tokenshards.END], "<u2").tobytes(), 0, []
    for _, r in read.sort_values(["file_path", "row_index"]).iterrows():
        raw = encode(r["text"]) + end
        used += [(number + k, r["doc_id"], k, raw[16 * k:16 * k + 16]) for k in range(-(-len(raw) // 16))]
        number += -(-(len(r["text"].encode()) + 1) // 8)
    image = tokenshards.permuted(np.array([u[0] for u in used]), number, 99)
    order = np.argsort(image)
    got = got.sort_values("slot")
    assert got["slot"].tolist() == list(range(len(used)))
    assert got["shard"].tolist() == (image[order] // 10).tolist() and got["shard"].nunique() > 64
    assert list(zip(got["id"], got["seq"])) == [used[i][1:3] for i in order]
    assert [bytes(stored[k]) for k in range(len(used))] == [used[i][3] + end * (8 - len(used[i][3]) // 2) for i in order]
    assert len(list((tmp_path / "shards").glob("shard-*.bin"))) == got["shard"].nunique()


def test_empty_table_has_no_shards(spark, no_docs, tmp_path):
    no_docs.write.parquet(f"{tmp_path}/docs")
    assert tokenshards.write_training_order(f"{tmp_path}/docs", f"{tmp_path}/out", spark).count() == 0


def test_query_tokens_are_whole(spark, sf):
    import zlib

    got = queries.QUERIES["op5_training_order"](spark, sf).orderBy("doc_id", "seq").toPandas()
    encode, end = tokenshards.Encoder(tokenshards.VOCABULARY), np.array([tokenshards.END], "<u2").tobytes()
    want = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect():
        raw = encode(r["text"] or "") + end
        for a in range(0, len(raw), 1024):
            want.append(zlib.crc32(raw[a:a + 1024] + end * (512 - len(raw[a:a + 1024]) // 2)))
    assert got["tokens_crc32"].tolist() == want and sorted(got["slot"]) == list(range(len(want)))


def test_packing_keeps_columns_named_like_helpers(odd_docs):
    named = odd_docs.withColumnsRenamed({"lang": "_h", "source": "bucket", "n_chars": "_text"})
    got = packing.pack_documents(named, keep=("doc_id", "_h", "bucket", "_text"), with_text=True)
    assert got.where("doc_id = 10").select("_h", "bucket", "_text").distinct().collect() == [("de", "d", 18)]
