"""Cover trees and signature trees against all pairs; components."""
import numpy as np
import pyarrow as pa
import pytest

from ledgerlens.llm import cover_pairs as C
from ledgerlens.llm import signature_join as S
from ledgerlens.llm.components import components

from .helpers import EDGE_DOCS, EDGE_SCHEMA, edited, jaccard_components, prose, smallest_reachable, with_clashes


def test_components(spark):
    rng = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (250, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    assert got == smallest_reachable({n for x in real for n in x}, real)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 16))
    x = np.concatenate([rng.normal(size=(150, 16)), base[rng.integers(0, 40, 200)] + rng.normal(size=(200, 16)) * .08,
                        np.repeat(base[:1], 120, 0), base[1] * rng.uniform(.5, 3, (80, 1)), base[2] + rng.normal(size=(100, 16)) * .03])
    labels, ids = rng.integers(0, 2, len(x)), rng.permutation(5000)[:len(x)]
    u = x / np.linalg.norm(x, axis=1)[:, None]
    hit = (u @ u.T >= 0.98) & (labels[:, None] == labels[None])
    np.fill_diagonal(hit, False)
    return x, labels, ids, hit


@pytest.mark.parametrize("max_cell", [50, 8192])
def test_cover_pairs_equal_all_pairs(spark, vectors, max_cell):
    x, labels, ids, hit = vectors
    rows = [(int(i), [float(z) for z in v], int(c), "clash") for i, v, c in zip(ids, x, labels)]
    odd = [(9001, None, 1), (9002, [0.0] * 16, 1), (9003, [float("nan")] + [1.0] * 15, 1), (9004, rows[0][1], None), (9005, [1.0, 2.0], 1),
           (9006, [None] + [1.0] * 15, 0), (9007, [float("inf")] + [1.0] * 15, 0), (9008, [], 0), (None, rows[0][1], 1)]
    df = spark.createDataFrame(rows + [(*o, "clash") for o in odd], "vec_id long, embedding array<double>, label int, n_links string")
    got = C.near_duplicates(df, max_cell=max_cell).toPandas()
    assert len(got) == len(df.collect())
    got = got[got.vec_id.notna()].set_index("vec_id")
    comp = smallest_reachable(set(ids.tolist()), [(int(ids[a]), int(ids[b])) for a, b in zip(*np.nonzero(hit))])
    assert (got.loc[ids].n_links.values == hit.sum(1)).all()
    assert (got.loc[ids].component_id.values == [comp[int(i)] for i in ids]).all()
    odd_ids = [o[0] for o in odd if o[0]]
    assert (got.loc[odd_ids].n_links == 0).all() and got.loc[odd_ids].kept.all()
    assert (got.kept == (got.component_id == got.index)).all()


def test_dense_cells_are_cut_into_pairs_of_chunks(spark):
    """Points too close for pivots, and a cell of few natives and many guests: no task holds over two chunks."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=16) + rng.normal(size=(1200, 16)) * .05
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = [("a|16", True, i, 1, bytearray(v.tobytes()), 0.0) for i, v in enumerate(x[:600])]
    rows += [("b|16", i < 630, i, 1, bytearray(v.tobytes()), 0.0) for i, v in enumerate(x[600:], 600)]
    cells = C._cells(spark.createDataFrame(rows, C._ROW), 0.2, 60)
    assert max(r["count"] for r in cells.groupBy("cell").count().collect()) <= 2 * 60 * 1.5
    found = cells.groupBy("cell").applyInArrow(C._cell_links(0.98), "a long, b long, w long").where("b is null").collect()
    got = np.zeros(1200, int)
    for r in found:
        got[r["a"]] += r["w"]
    hit = x @ x.T >= 0.98
    np.fill_diagonal(hit, False)
    side = np.arange(1200) // 600
    hit &= (side[:, None] == side) & ((side == 0) | (np.arange(1200) < 630))[:, None] | (side[:, None] == side) & ((side == 0) | (np.arange(1200) < 630))[None]
    assert (got == hit.sum(1)).all() and got.sum() > 0


def test_cover_pairs_repeated_rows_and_empty(spark):
    df = spark.createDataFrame([(7, [1.0, 0.0], 1), (7, [1.0, 0.0], 1), (9, [2.0, 0.0], 1)], "vec_id long, embedding array<float>, label int")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in C.near_duplicates(df).collect())
    assert got == [(7, 2, 7), (7, 2, 7), (9, 2, 7)]
    assert C.near_duplicates(df.limit(0)).count() == 0


def _corpus():
    docs = [(i, prose(i, 5 + 3 * (i % 60))) for i in range(100)]
    docs += [(200 + i, edited(prose(500 + i % 9, 150), i, (i % 7) / 100 + .003)) for i in range(60)]           # near copies
    docs += [(300 + i, prose(77, 80)) for i in range(20)]                                                       # exact copies
    docs += [(400 + i, prose(1000 + i, 30) + " " + prose(42, 60)) for i in range(40)]                           # a shared passage
    docs += [(500 + i, " ".join(prose(43, 400).split()[i:i + 200])) for i in range(0, 60, 4)]                   # sliding windows: a chain
    docs += [(600 + i, " ".join(f"t{j}" for j in range(4 + i % 9))) for i in range(40)]                         # short texts
    return docs


@pytest.mark.parametrize("k,num,den,block", [(4, 85, 100, 1000), (5, 80, 100, 12), (3, 50, 100, 1000)])
def test_signature_join_equals_all_pairs(spark, k, num, den, block):
    docs = _corpus()
    want = jaccard_components(docs, k, num, den)
    df = with_clashes(spark.createDataFrame(docs, EDGE_SCHEMA))
    got = {r["doc_id"]: r["component_id"] for r in S.jaccard_groups(df, k, num, den, block=block).collect()}
    assert got == want


def test_a_family_below_the_threshold_stays_in_bounded_tasks(spark):
    """Nothing links: no task holds more than about two blocks."""
    import pyarrow as pa
    rows = spark.range(2000).selectExpr("id as doc_id", "1L as grp", "100 + id % 40 as n_shingles", "2000L as members", "240000L as shingles")
    payload = spark.range(2000).selectExpr("id as doc_id")
    size = lambda t: pa.table({"a": pa.array([t.num_rows], pa.int64()), "b": pa.array([t.num_rows], pa.int64())})
    held = [r["a"] for r in S._connected(rows, payload, size, 100, ["doc_id"], 85, 100).collect()]
    assert max(held) < 3 * 100


@pytest.mark.parametrize("k,num,den", [(4, 85, 100), (5, 80, 100)])
def test_families_of_template_pages_equal_all_pairs(spark, k, num, den):
    """Much shared wording, most pairs below the threshold, some at and above it."""
    docs = [(i, edited(prose(1, 120), i, 0.05 + 0.001 * (i % 40))) for i in range(150)]
    docs += [(1000 + i, edited(docs[7 * i][1], 900 + i, .01 + .005 * (i % 3))) for i in range(20)]
    df = spark.createDataFrame(docs, EDGE_SCHEMA)
    got = {r["doc_id"]: r["component_id"] for r in S.jaccard_groups(df, k, num, den, block=12).collect()}
    assert got == jaccard_components(docs, k, num, den) and 100 < len(set(got.values())) < 170


def test_signature_join_edges(spark):
    df = with_clashes(spark.createDataFrame(EDGE_DOCS, EDGE_SCHEMA))
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in S.jaccard_groups(df, 4, 85, 100).collect()]
    assert sorted(got, key=str) == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 1, 6), (7, 1, 6),
                                           (None, 1, None), (8, 1, 8)], key=str)
    assert S.jaccard_groups(df.limit(0), 4, 85, 100).count() == 0
    kept = S.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [1, 2, 3, 4, 6, 8]     # the row without an id is a copy of 6


def test_one_row_of_each_group(spark):
    """Repeated rows, versions of an id and rows without an id: one of each group stays."""
    t = prose(1, 60)
    rows = [(5, t, "a"), (5, t, "a"), (5, t, "b"), (9, t, "c"), (None, t, "d"), (None, t, "d"), (None, edited(t, 1, .02), "e"),
            (None, prose(2, 50), "f"), (None, prose(2, 50), "g"), (7, None, "h"), (7, None, "h"), (8, "", "i"), (None, None, "j"), (None, " ", "k"), (None, None, "j"),
            (3, prose(3, 40), "l"), (4, edited(prose(3, 40), 2, .02), "m")]
    got = S.one_of_each(with_clashes(spark.createDataFrame(rows, "doc_id long, text string, extra string")), k=5, num=80, den=100)
    kept = sorted((str(r["doc_id"]), r["text"] or "", r["extra"]) for r in got.collect())
    assert got.columns[:3] == ["doc_id", "text", "extra"]
    assert [x[0] for x in kept] == ["3", "5", "7", "8", "None", "None", "None", "None"]
    assert [x for x in kept if x[0] == "5"][0][1] == t
    assert sum(x[0] == "None" and x[1] == prose(2, 50) for x in kept) == 1
    assert S.one_of_each(spark.createDataFrame([], EDGE_SCHEMA), k=5, num=80, den=100).count() == 0


def test_keys_meet_for_every_linked_pair():
    """The candidate keys lose no pair at the threshold, at any size."""
    rng = np.random.default_rng(3)
    for n in [*range(1, 40), 60, 100, 121, 122, 193, 400, 1000, 3000]:
        for num in (85, 80, 50):
            for _ in range(6):
                a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
                for drop in range(n):
                    b = a[rng.permutation(len(a))[drop:]] if rng.random() < .5 else np.concatenate(
                        [a[rng.permutation(len(a))[drop:]], rng.integers(0, 1 << 63, max(1, drop // 2), dtype=np.uint64)])
                    b = np.unique(b)
                    if len(b) and S.links(a, b, num, 100):
                        assert np.intersect1d(S.part_keys(a, num, 100), S.part_keys(b, num, 100)).size, (n, drop, num)
                    if drop > n // 2 + 2 or drop > 30 and rng.random() < .9:
                        break


def test_rounds_hold_every_key_once():
    keys = np.r_[np.random.default_rng(3).integers(-2**63, 2**63 - 1, 2000), -2**63, -1, 0, 2**63 - 1]
    rounds = S.in_rounds(keys)
    assert len(rounds) == S.ROUNDS and sorted(np.concatenate(rounds)) == sorted(keys) and all(len(r) > 300 for r in rounds)


def test_large_tables_and_shuffles_go_when_they_are_read(spark, monkeypatch, tmp_path):
    """The stages after this one share its disk."""
    import glob
    from ledgerlens.llm import common
    made = []

    def path(spark, name):
        made.append((name, f"file://{tmp_path}/ledgerlens/{name}-{len(made)}"))
        return made[-1][1]
    monkeypatch.setattr(common, "scratch_path", path)
    texts = [prose(i, 60) for i in range(30)]
    docs = [(i, t) for i, t in enumerate([*texts, *texts[:5], *(edited(t, 1, 0.02) for t in texts[:5])])]
    assert S.one_of_each(spark.createDataFrame(docs, "doc_id long, text string"), k=5, num=80, den=100).count() == 30
    left = {g.rsplit("/", 1)[1].rsplit("-", 1)[0] for g in glob.glob(f"{tmp_path}/ledgerlens/*")}
    assert {"llm-sets", "llm-firsts", "llm-near"} <= {n for n, _ in made} and not left & {"llm-sets", "llm-firsts", "llm-near"}
    # a stored table's own query leaves no shuffle files, and the session's setting stays
    from ledgerlens.llm.common import CLEANUP, store
    seen, write = [], type(spark.range(1).write).parquet
    monkeypatch.setattr(type(spark.range(1).write), "parquet", lambda self, p: (seen.append(spark.conf.get(CLEANUP, None)), write(self, p))[1])
    before = spark.conf.get(CLEANUP, None)
    assert store(spark.range(100).repartition(3, "id"), "some").count() == 100
    assert seen == ["true"] and spark.conf.get(CLEANUP, None) == before


def test_linked_sets_share_as_many_keys_as_needed():
    rng = np.random.default_rng(7)
    pool = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    seen = 0
    for _ in range(4000):
        n, num = int(rng.integers(1, 120)), int(rng.choice([50, 80, 85, 100]))
        a = np.unique(np.r_[rng.choice(pool, n // 3, replace=False), rng.integers(0, 1 << 63, n, dtype=np.uint64)])
        b = np.unique(np.r_[a[rng.random(len(a)) > rng.random() / 3], rng.integers(0, 1 << 63, int(rng.integers(0, 1 + n // 5)), dtype=np.uint64)])
        if not len(b) or not S.links(a, b, num, 100):
            continue
        seen += 1
        need = int(S.needed(np.array([len(a)]), np.array([len(b)]), num, 100)[0])
        for frequent in (np.empty(0, np.uint64), np.sort(pool)):
            assert len(np.intersect1d(S.part_keys(a, num, 100, frequent), S.part_keys(b, num, 100, frequent))) >= need >= 1
    assert seen > 500
    assert S.needed(np.array([100]), np.array([79]), 80, 100)[0] == 0


def test_keys_meet_in_pieces(monkeypatch):
    """Pairs of short keys and stars of long ones, however the sorted rows are cut."""
    monkeypatch.setattr(S, "RUN", 4)
    monkeypatch.setattr(S, "_ROWS", 7)
    rng = np.random.default_rng(1)
    for _ in range(60):
        key, at = rng.integers(0, 12, 80), rng.integers(0, 30, 80)
        rows = sorted(zip(key.tolist(), at.tolist()))
        cut = int(rng.integers(0, len(rows) + 1))
        pairs, links, ends = [], [], []
        for part in (rows[:cut], rows[cut:]):
            batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in part[i:i + 5]], pa.int64()), pa.array([r[1] for r in part[i:i + 5]], pa.int64()),
                                                   pa.array([10] * len(part[i:i + 5]), pa.int64())], names=["key", "h1", "n"]) for i in range(0, len(part), 5)]
            for b in S._met(80, 100)(iter(batches)):
                for r in b.to_pylist():
                    (ends if r["key"] is not None else pairs if r["need"] else links).append((r["key"], r["a"]) if r["key"] is not None else (r["a"], r["b"]))
        links += [(a, b) for k, a in ends for m, b in ends if k == m and a != b]
        held = {k: sorted({d for x, d in rows if x == k}) for k in set(key.tolist())}
        joined = smallest_reachable(range(30), links)
        for k, sets in held.items():
            if len(sets) > 4:
                assert len({joined[d] for d in sets}) == 1, k
        for x in range(30):
            for y in range(x):
                together = [k for k, sets in held.items() if x in sets and y in sets]
                assert joined[x] == joined[y] or pairs.count((y, x)) == len(together)
                assert pairs.count((y, x)) <= len(together) and not pairs.count((x, y))


def test_a_common_passage_makes_no_group(spark, monkeypatch):
    """Texts of their own that share a passage are never compared, so more of them cost no more each."""
    passage, grouped = prose(10_000, 60), []
    whole = S._in_classes

    def seen(groups, num, den):
        grouped.append(groups.count())
        return whole(groups, num, den)
    monkeypatch.setattr(S, "_in_classes", seen)
    docs = [(i, f"{prose(i, 90)} {passage} {prose(5_000 + i, 90)}") for i in range(240)]
    docs += [(1000 + i, edited(docs[i][1], i, 0.01)) for i in range(5)]
    got = {r["doc_id"]: r["component_id"] for r in S.jaccard_groups(spark.createDataFrame(docs, "doc_id long, text string"), k=5, num=80, den=100).collect()}
    assert got == jaccard_components(docs, 5, 80, 100)
    assert grouped[0] <= 20
