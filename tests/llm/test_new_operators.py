"""Vector codes, spot signatures and the filter audit against brute-force versions."""

import collections
import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest

from crosspanel.llm import audit, codes, spots

KEPT_SCHEMA = "vec_id long, embedding array<float>, label int, code string, v int, kind string, part string"


def vectors(n=900, width=16, seed=3):
    rng = np.random.default_rng(seed)
    centre = rng.normal(0, 0.3, (12, width))
    rows = [(i, (centre[rng.integers(12)] + rng.normal(0, 0.05, width)).astype(np.float32).tolist(), int(rng.integers(3)), "x", 1, "y", "z") for i in range(n)]
    rows += [(n + i, rows[5][1], None, "x", 1, "y", "z") for i in range(300)]  # a hot vector, without a label
    rows += [(5000, None, 1, "x", 1, "y", "z"), (5001, [0.1] * 5 + [None] + [0.1] * 10, 1, "x", 1, "y", "z"), (5002, [float("nan")] * width, 1, "x", 1, "y", "z"), (5003, [float("inf")] + [0.0] * (width - 1), 1, "x", 1, "y", "z")]
    rows += [(5004, [], 1, "x", 1, "y", "z"), (5005, [0.5] * 3, 2, "x", 1, "y", "z"), (7, rows[8][1], 1, "x", 1, "y", "z"), (None, rows[9][1], 1, "x", 1, "y", "z")]
    return rows


def lloyd(rows, rounds=codes.ROUNDS):
    """Plain rounds on Python integers, no bounds: {(id, vector): (code, error)} and the codebooks' digest."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    length = -(-max(len(r[1]) for r in kept) // 8) * 8
    whole = [[math.floor(np.float32(x) * 4096.0) for x in r[1]] + [0] * (length - len(r[1])) for r in kept]
    kept_order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))
    w = length // 8
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(whole[i], p) for i in kept_order[:16]] for p in range(8)]

    def assign():
        out = []
        for v in whole:
            out.append([min((sum((a - b) ** 2 for a, b in zip(cut(v, p), c, strict=True)), e) for e, c in enumerate(books[p])) for p in range(8)])
        return out

    for _ in range(rounds):
        got = assign()
        for p in range(8):
            for e in range(len(books[p])):
                own = [cut(v, p) for v, g in zip(whole, got, strict=True) if g[p][1] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    got = assign()
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(r[0], r[2], "".join(f"{e:02x}" for _, e in g), sum(d for d, _ in g)) for r, g in zip(kept, got, strict=True)], digest


def test_codes_equal_plain_rounds(spark):
    rows = vectors()
    found = codes.encode(spark.createDataFrame(rows, KEPT_SCHEMA).repartition(5)).collect()
    want, digest = lloyd(rows)
    total = collections.Counter()
    for _, label, _, error in want:
        total[label] += error
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in found), key=key) == sorted(((i, c, e, total[lab]) for i, lab, c, e in want), key=key)
    assert {r.codebooks_sha256 for r in found} == {digest}


def test_bounds_save_comparisons(spark):
    df = spark.createDataFrame(vectors(), KEPT_SCHEMA)
    books, _ = codes.fit(df)
    parts = 8 * df.where(codes.usable("embedding")).count()
    assert len(books.history) == codes.ROUNDS + 1 and books.rescanned[0] == parts
    assert books.rescanned[-1] < parts / 2 and sum(books.rescanned[1:]) < parts * codes.ROUNDS * 0.6


def test_net_displacement_is_no_more_than_the_drifts():
    rng = np.random.default_rng(1)
    books = codes.Books([rng.integers(-99, 99, (8, 16, 2)) for _ in range(5)], 16)
    own, others = books.moved()
    drift = np.zeros((8, 16))
    for t in (3, 2, 1, 0):
        drift += np.sqrt(((books.history[t + 1] - books.history[t]) ** 2).sum(-1))
        assert (own[t] <= drift + 1e-9).all()
    assert (own[4] == 0).all() and others[0, 0, 3] == np.delete(own[0, 0], 3).max()


def test_codes_of_few_and_no_vectors(spark):
    assert codes.encode(spark.createDataFrame([], KEPT_SCHEMA)).collect() == []
    assert codes.encode(spark.createDataFrame([(1, None, 1, "", 1, "", "")], KEPT_SCHEMA)).collect() == []
    rows = [(3, [1.0] * 8, None, "", 1, "", ""), (1, [-0.1] * 8, None, "", 1, "", "")]
    found = {r.vec_id: r for r in codes.encode(spark.createDataFrame(rows, KEPT_SCHEMA)).collect()}
    assert found[1].code == "00" * 8 and found[3].code == "01" * 8 and found[1].error == found[1].label_error == 0
    with pytest.raises(Exception, match="too large"):
        codes.encode(spark.createDataFrame([(1, [1e30] * 8, 1, "", 1, "", "")], KEPT_SCHEMA)).collect()


def test_distances_in_both_widths():
    x, book = np.array([[2**28, -(2**28)], [3, 4]]), np.array([[0, 0], [-(2**28), 2**28]])
    assert codes.distances(x, book).tolist() == [[2**57, 2**59], [25, (3 + 2**28) ** 2 + (4 - 2**28) ** 2]]


# ---- filter audit

TEXTS = "Alpha beta gamma DELTA eps # zeta eta".split()


def audited():
    r = random.Random(5)
    docs = [(i, r.choice([None, "", " \n", " ".join(r.choice(TEXTS) + str(r.randrange(r.choice([2, 500]))) for _ in range(r.choice([3, 99, 100, 101, 160])))]), r.choice(["en", "de", None, ""]), "s", 1) for i in range(120)]
    docs += [(200 + i, docs[i][1], "xx", "s", 1) for i in range(40)] + [(300 + i, "same text " * 60, "hot", "s", 1) for i in range(150)]
    docs += [docs[7], docs[7], (None, docs[4][1], "en", "s", 1), (None, "só ünïcode ÀÉ Words", "only", "s", 1)]
    labels = [(r.randrange(330), r.choice([0, 1, None]), r.choice([0, 1, None]), 1) for _ in range(300)] + [(None, 1, 1, 1)]
    return docs, labels


def audit_by_hand(docs, labels):
    good, toxic = {i for i, q, _, _ in labels if q == 1}, {i for i, _, t, _ in labels if t == 1}
    first = {}
    for i, t, *_ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    rows = []
    for i, t, lang, *_ in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and first[t] < i}
        rows.append((lang or "", {f for f in fails if fails[f]}, i is not None and i in good, i is not None and i in toxic))
    out, shapley = {}, collections.Counter()
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                gone = set(order[: step - 1])
                removed = [r for r in own if f in r[1] and not gone & r[1]]
                out[part, order, step] = [sum(not (gone | {f}) & r[1] for r in own), len(removed), sum(f in r[1] and bool(gone & r[1]) for r in own), sum(r[1] == {f} for r in own), sum(r[2] for r in removed), sum(r[3] for r in removed)]
                shapley[part, f] += len(removed)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_against_all_orders(spark):
    docs, labels = audited()
    found = audit.interactions(spark.createDataFrame(docs, "doc_id long, text string, lang string, part string, fails int").repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, good int")).collect()
    assert {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in found} == audit_by_hand(docs, labels)
    assert len(found) == 600 * len({d[2] or "" for d in docs})


def test_audit_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.interactions(none, labels).collect() == []


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 27, 1000, 4099])
def test_carry_save_counts(n):
    words = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint32)
    assert audit.counted_bits(words).tolist() == [int((words >> np.uint32(b) & np.uint32(1)).sum()) for b in range(32)]


# ---- spot signatures


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(["the", "of", "and", "in"]) if r.random() < 0.4 else "w" + str(r.randrange(3000)) for _ in range(n)) + "."


def spotted_docs():
    out = [(0, None), (1, ""), (2, " !? "), (3, "the of"), (4, "The, OF!"), (5, "eins"), (6, prose(1, 40000))]
    out += [(10 + i, prose(100 + i, 30 + 5 * i)) for i in range(40)]
    out += [(100 + i, prose(104, 50)) for i in range(25)]  # copies
    base = prose(77, 300).split()
    for i in range(60):  # near copies, each with a word of its own
        w = list(base)
        w[random.Random(i).randrange(len(w))] = f"own{i}"
        out.append((200 + i, " ".join(w)))
    half = prose(78, 150)
    out += [(300, half + " " + prose(79, 60)), (301, half + " " + prose(80, 60)), (302, half)]
    out += [(7, "twice told tale of the sea"), (7, "twice told tale of the sea"), (7, "another of the same id")]
    return out


@pytest.fixture(scope="module")
def spot_docs(spark):
    return spark.createDataFrame([(i, t, "a", [1], 2) for i, t in spotted_docs()], "doc_id long, text string, tokens string, spots array<int>, edited int").repartition(4)


def spots_by_hand(text, words):
    tokens = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
    chain = lambda a: " ".join([w for w in tokens[a : a + spots.REACH] if w not in words][: spots.CHAIN])
    found = {w + "\n" + chain(i + 1) for i, w in enumerate(tokens) if w in words and chain(i + 1)} | ({"\n" + chain(0)} if chain(0) else set())
    return found or ({" ".join(tokens)} if tokens else set())


def near(a, b):
    return 1.0 if a == b else len(a & b) / len(a | b)


def test_fingerprints_against_sets(spark, spot_docs):
    rows = [(i, t or "") for i, t in spotted_docs()]
    words = spots.anchors(spot_docs.select("doc_id", "text"))
    assert {"the", "of", "and", "in"} <= set(words)
    found = collections.defaultdict(list)
    for r in spots.fingerprints(spot_docs).collect():
        found[r.doc_id].append(r)
    ids = sorted({i for i, _ in rows if i != 7}, reverse=True)
    text = dict(rows)
    for at, i in enumerate(ids):
        after = ids[(at + 1) % len(ids)]
        if {i, after} & {8, 6, 10} or i not in found:  # neighbours of the repeated id follow a hash
            continue
        (r,) = found[i]
        t, n = text[i], text[after]
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        own = spots_by_hand(t, words)
        assert len(r.fingerprint) == 8 * len(own) and r.near_edited == pytest.approx(near(own, spots_by_hand(edited, words)), abs=1e-3)
        assert r.near_next == pytest.approx(near(own, spots_by_hand(n, words)), abs=1e-3)
    assert len(found[7]) == 3 and sum(map(len, found.values())) == len(rows)
    assert len({found[i][0].fingerprint for i in range(100, 125)}) == 1 and found[101][0].near_next == 1.0
    assert found[0][0].fingerprint == "" and found[3][0].fingerprint == found[4][0].fingerprint != ""


def test_edges_of_fingerprints(spark, spot_docs):
    assert spots.fingerprints(spot_docs.where("doc_id < 0")).collect() == []
    (one,) = spots.fingerprints(spot_docs.where("doc_id = 302")).collect()
    t = dict(spotted_docs())[302]
    assert one.edited_sha256 == hashlib.sha256((t[: len(t) - len(t) // 2] + t[: len(t) // 2]).encode()).hexdigest() and one.near_next == 1.0
    none = spark.createDataFrame([(None, "a b"), (None, None), (4, "c d")], "doc_id long, text string")
    assert len(spots.fingerprints(none).collect()) == 3


def classes_by_hand(rows, words):
    """Smallest doc_id reached through all pairs."""
    own = [(i, spots_by_hand(t, words)) for i, t in rows if i is not None]
    root = {i: i for i, _ in own}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, s), (b, t) in itertools.combinations(own, 2):
        if a == b or (s and t and len(s & t) * 100 >= 80 * len(s | t)):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in root}


def chained():
    """A chain of neighbours, a hot group around several centres, sets at the bound, and spots that all share."""
    r = random.Random(9)
    common = [f"c{i}" for i in range(40)]
    out, words = [], [f"v{i}" for i in range(60)]
    for i in range(25):
        out.append((i, " the ".join(words)))
        words = [*words[2:], f"n{i}a", f"n{i}b"]
    for g in range(4):
        centre = [w if r.random() < 0.75 else f"g{g}{w}" for w in common]
        for i in range(45):
            out.append((100 + 50 * g + i, " the ".join(w if r.random() < 0.98 else f"{w}x{r.randrange(10**6)}" for w in centre)))
    out += [(400, " the ".join(f"b{i}" for i in range(10))), (401, " the ".join(f"b{i}" for i in range(8))), (402, "the x"), (403, "the x")]
    return out


@pytest.mark.parametrize("turns", [0, 1, 6])
def test_near_classes_against_all_pairs(spark, monkeypatch, turns):
    monkeypatch.setattr(spots, "LEADERS", turns)
    docs = spark.createDataFrame(chained(), "doc_id long, text string").repartition(3)
    words = spots.anchors(docs)
    found = spots.class_roots(spots.with_spots(docs, "text", "spots", words).select("doc_id", "spots"))
    want = classes_by_hand(chained(), words)
    got = {r.node: r.root for r in found.collect()}
    assert {i: got.get(i, i) for i in want} == want
    assert sorted(collections.Counter(want.values()).values())[-3] > 5


def test_classes_of_documents(spark, spot_docs):
    rows = [(i, t or "") for i, t in spotted_docs()]
    want = classes_by_hand(rows, spots.anchors(spot_docs.select("doc_id", "text")))
    found = {(r.doc_id, r.class_id) for r in spots.near_classes(spot_docs).collect()}
    assert found == set(want.items()) and want[201] == 200 and want[110] == 14
