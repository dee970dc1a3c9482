from collections import Counter, defaultdict

from raceflow.llm import sharding


def placed(df, **kw):
    return [r.asDict() for r in sharding.propagate(df, **kw).collect()]


def law_holds(rows, shards=16):
    sizes = Counter(r["shard"] for r in rows)
    counts = [sizes.get(s, 0) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    for s in range(shards):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = placed(docs)
    law_holds(rows)
    texts = dict(docs.select("doc_id", "text").collect())
    groups = defaultdict(list)
    for r in rows:
        assert r["size"] == len(texts[r["doc_id"]].encode()) + 1
        groups[texts[r["doc_id"]]].append(r["shard"])
    linked = [g for g in groups.values() if len(g) > 1]
    assert linked and all(len(set(g)) == 1 for g in linked)  # all groups are small here


def test_hot_group_is_split_evenly(make_docs):
    rows = placed(make_docs([(i, "x" if i % 3 == 0 else f"t{i // 2}") for i in range(960)]))
    law_holds(rows)
    hot = Counter(r["shard"] for r in rows if r["doc_id"] % 3 == 0)
    assert sum(hot.values()) == 320 and max(hot.values()) <= 60
    apart = sharding.cut_links(sharding.propagate(make_docs([(i, f"t{i // 3}") for i in range(480)]))).first()
    assert apart["groups"] == 160 and apart["whole"] >= 150


def test_fewer_cuts_than_without_rounds(make_docs):
    docs = make_docs([(i, f"t{i // 4}") for i in range(800)])
    start, end = (sharding.cut_links(sharding.propagate(docs, rounds=n)).first()["apart"] for n in (0, 3))
    assert end < start / 10


def test_awkward(awkward, nothing):
    rows = placed(awkward)
    assert len(rows) == awkward.count()
    law_holds(rows)
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[1]["size"] == 1 and by_id[1]["hub"] is None and by_id[2]["size"] == 1
    two = {r["doc_id"]: r for r in placed(awkward, shards=2)}
    assert two[9]["shard"] == two[10]["shard"]
    assert placed(nothing) == []
    out = sharding.shard_documents(awkward)
    assert out.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def test_small_groups_stay_whole_beside_a_hot_one(make_docs):
    docs = make_docs([(i, "x" if i % 3 == 0 else f"t{(i - i // 3) // 4}") for i in range(2400)])
    rows = placed(docs)
    law_holds(rows)
    small = defaultdict(set)
    for r in rows:
        if r["doc_id"] % 3:
            small[r["hub"]].add(r["shard"])
    assert len(small) > 390 and all(len(s) == 1 for s in small.values())


def test_groups_of_all_sizes_stay_whole(make_docs, monkeypatch):
    monkeypatch.setattr(sharding, "FEW", 20)
    texts = ["big"] * 90 + ["half"] * 50 + [f"s{i // 5}" for i in range(1000)] + [f"t{i // 12}" for i in range(240)]
    rows = placed(make_docs(list(enumerate(texts + [f"u{i}" for i in range(220)]))))
    law_holds(rows)
    cut = sharding.cut_links(sharding.propagate(make_docs(list(enumerate(texts + [f"u{i}" for i in range(220)]))))).first()
    assert cut["groups"] == cut["whole"] == 222 and cut["apart"] == 0


def pairs_kept(rows):
    return sum(n * (n - 1) // 2 for n in Counter((r["hub"], r["shard"]) for r in rows if r["hub"] is not None).values())


def test_a_group_larger_than_a_shard_fills_whole_shards(make_docs):
    rows = placed(make_docs([(i, "x" if i % 3 == 0 else f"t{i // 2}") for i in range(960)]))
    law_holds(rows)
    hot = [r for r in rows if r["doc_id"] % 3 == 0]
    assert pairs_kept(hot) >= 8_500  # 9,040 if nothing else were there
    assert pairs_kept(rows) - pairs_kept(hot) == 160  # all other pairs of equal texts


def test_a_round_matches_a_plain_one(spark):
    """Wishes from the labels of that round: a node moves only where it has more neighbours, and gains count them."""
    import random
    from raceflow.session import cut_lineage
    draw = random.Random(4)
    at = {n: draw.randrange(4) for n in range(60)}
    links = sorted({(n, draw.randrange(25)) for n in range(60) for _ in range(2)})
    table = cut_lineage(spark.createDataFrame(links, "node long, hub long"))
    for number in range(3):
        nodes = cut_lineage(spark.createDataFrame([(n, 1, s) for n, s in at.items()], "node long, weight long, shard int"))
        after = {r["node"]: r["shard"] for r in sharding._round(nodes, table, [60] * 4, number).collect()}  # room for all
        assert sorted(after) == sorted(at)
        moved = [n for n in at if after[n] != at[n]]
        for n in at:
            near = Counter(at[m] for h in {h for k, h in links if k == n} for m, g in links if g == h and m != n)
            if n in moved:
                assert near[after[n]] == max(near.values()) > near[at[n]]
        assert moved
        at = after


def test_labels_gather_what_other_hubs_link(spark, make_docs):
    """Chains of documents through hubs, no equal texts: neighbours come together under equal row counts."""
    docs = make_docs([(i, f"text {i}") for i in range(640)])
    links = spark.createDataFrame([(i * 37 % 640, i // 8) for i in range(640)] + [(i * 37 % 640, 1000 + i // 16) for i in range(0, 640, 4)], "doc_id long, hub long")
    shares = []
    for rounds in (0, 8):
        out = sharding.propagate(docs, shards=8, rounds=rounds, links=links)
        law_holds([r.asDict() for r in out.collect()], 8)
        found = sharding.kept_links(out, links).first()
        shares.append(found["kept"] / found["pairs"])
    assert shares[0] < 0.25 and shares[1] > 0.6


def test_odd_links(spark, awkward, nothing):
    links = spark.createDataFrame([(None, 1), (4, None), (4, 7), (10, 7), (77, 7), (5, 9)], "doc_id long, hub long")
    rows = placed(awkward, links=links)
    law_holds(rows)
    assert len(rows) == awkward.count() and placed(nothing, links=links) == []


def test_shared_lines(make_docs):
    line = "a line that two documents hold, long enough to say something"
    got = sharding.shared_lines(make_docs([(1, f"one\n  {line}"), (2, f"{line}\n{line}\ntwo"), (3, line + "!"), (4, None), (None, line)])).collect()
    assert sorted(r["doc_id"] for r in got) == [1, 2] and len({r["hub"] for r in got}) == 1
