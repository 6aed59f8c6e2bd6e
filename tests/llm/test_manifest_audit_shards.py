"""Merkle manifest, source audit and resharding against brute-force versions on small rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stemma.llm import divergence, merkle, resharding
from stemma.session import new_folder

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, tree string, digest string, rank int, n int, block int,"
    " run int, path string, term string, shard int, slot int, part int, at int, size int, `row` int, `a.b` int"
)
EXTRA = ("t", "d", 1, 2, 3, 4, "p", "w", 5, 6, 7, 8, 9, 10, 11)


def table(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA)


def edge_rows(n=70):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["the", "The", "straße", "ÉTÉ", "x1y", "on-off", "is", "\U0001F600"]) for _ in range(rng.randrange(1, 30)))
             for _ in range(12)]
    rows = [(k, rng.choice(texts) + ("\nend" if k % 3 else ""), rng.choice(["en", "de", None]), rng.choice("aab") + rng.choice(["", "x"]), k)
            for k in range(n)]
    rows += [(n, None, None, None, None), (n + 1, "", "", "", 0), (None, "the\nis", "en", "a", 3), (None, "the\nis", "en", "a", 3),
             (5, "the\nis", "en", "a", 3), (5, "the\nis", "en", "a", 3), (n + 2, "on " * 9000, "en", "solo", 27000), (n + 3, "\n\t 12", "fr", "ax", 5)]
    return rows


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def told(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(doc_id, text, lang, source, n_chars):
    return sha(*map(told, (doc_id, source, lang, n_chars, text)))


def tree_paths(digests):
    """Root of a list of digests and the siblings (before, after) of each."""
    paths, held = [[] for _ in digests], [[k] for k in range(len(digests))]
    while len(digests) > 1:
        runs = [range(a, min(a + 3, len(digests))) for a in range(0, len(digests), 3)]
        for run in runs:
            for k in run:
                step = ("".join(digests[j] for j in run if j < k), "".join(digests[j] for j in run if j > k))
                for member in held[k]:
                    paths[member].append(step)
        held = [[m for k in run for m in held[k]] for run in runs]
        digests = [sha(*[digests[k] for k in run]) for run in runs]
    return digests[0], paths


def brute_manifest(rows):
    trees = defaultdict(list)
    for r in rows:
        trees[r[3]].append(((r[0] is not None, r[0] or 0, leaf(*r)), r))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    made = {}
    for s in names:
        trees[s].sort(key=lambda x: x[0])
        made[s] = tree_paths([k[2] for k, _ in trees[s]])
    root, tops = tree_paths([made[s][0] for s in names])
    out = []
    for s, top in zip(names, tops):
        for (key, r), own in zip(trees[s], made[s][1]):
            path, doc_id, text = own + top, r[0], r[1]
            node = key[2]
            if doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0:
                node = leaf(doc_id, text.replace("\n", ""), *r[2:])
            for before, after in path:
                node = sha(before, node, after)
            out.append((doc_id, key[2], made[s][0], root, sha(*[b + a for b, a in path]), node, node == root))
    return out


@pytest.mark.parametrize("digits", [1, 2, 7])
def test_manifest_is_the_tree_of_all_rows(spark, monkeypatch, digits):
    """Blocks of 3, 9 and 2,187 leaves: many rounds and one round give the same tree."""
    monkeypatch.setattr(merkle, "DIGITS", digits)
    monkeypatch.setattr(merkle, "BLOCK", merkle.FAN**digits)
    rows = edge_rows(20 if digits == 1 else 70)
    docs = table(spark, rows)
    found = merkle.verified(merkle.manifest(docs, shown=merkle.without_line_ends(docs)))
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(brute_manifest(rows), key=repr)


def test_manifest_of_one_row_and_of_none(spark):
    docs = table(spark, [(1, "a\nb", "en", None, 3)])
    (row,) = merkle.verified(merkle.manifest(docs)).collect()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.proof_sha256 == sha()
    assert merkle.verified(merkle.manifest(docs.limit(0))).count() == 0


def test_proofs_are_emitted_without_joins(spark):
    plan = merkle.manifest(table(spark, edge_rows(5)))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "explode" in plan


def brute_audit(rows, least, top):
    docs = [tuple("" if x is None else x for x in (r[2], r[3], r[1])) for r in rows]
    words = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), d[2])) for d in docs]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [(d[1], w) for d, w in zip(docs, words) if d[0] == lang]
        in_docs = Counter(t for _, w in mine for t in set(w))
        kept = {t for t, n in in_docs.items() if n >= least}
        count = {s: Counter() for s, _ in mine}
        for s, w in mine:
            count[s].update(t for t in w if t in kept)
        whole = sum(count.values(), Counter())

        def share(c, t):
            return 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept))

        for s, c in count.items():
            pairs = [(-sum(abs(share(c, t) - share(o, t)) for t in kept), name.encode(), name) for name, o in count.items() if name != s]
            terms = [(share(whole, t) - share(c, t), t.encode(), t) for t in kept if c[t] and share(c, t) > share(whole, t)]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item, -value, k) for k, (value, _, item) in enumerate(items, 1)]
    return out


@pytest.mark.parametrize("small", [False, True])
def test_audit_counts_every_term_of_every_pair(spark, monkeypatch, small):
    """Also with tiles of sources, slices of terms, parts of batches and lists of weights so small that all are cut."""
    if small:
        for name, value in (("TILE", 2), ("BLOCK_ROWS", 4), ("COLUMNS", 2), ("PART", 40), ("LISTED", 2)):
            monkeypatch.setattr(divergence, name, value)
    rows = edge_rows()
    found = divergence.audit(table(spark, rows), least_docs=3, top=2).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(brute_audit(rows, 3, 2), key=repr)


def test_audit_without_kept_terms_and_without_rows(spark):
    rows = [(1, "a b", "en", "x", 3), (2, None, "en", "y", 0), (3, "", None, None, 0)]
    found = divergence.audit(table(spark, rows))
    assert sorted(map(tuple, found.collect())) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]
    assert divergence.audit(table(spark, rows).limit(0)).count() == 0


def test_flow_has_no_cheaper_way():
    """No cycle of the residual graph has a negative cost."""
    rng = random.Random(9)
    for case in range(40):
        n, m = rng.randrange(1, 6), rng.randrange(1, 6)
        supply = [rng.choice([0, rng.randrange(50)]) for _ in range(n)]
        demand = [0] * m
        for _ in range(sum(supply)):
            demand[rng.randrange(m)] += 1
        cost = None if case % 2 else np.array([[rng.randrange(5) for _ in range(m)] for _ in range(n)])
        flow = resharding.cheapest_flow(supply, demand, cost)
        assert flow.sum(1).tolist() == supply and flow.sum(0).tolist() == demand and (flow >= 0).all()
        price = 1 - np.eye(n, m) if cost is None else cost
        far = np.full((n + m, n + m), np.inf)
        far[:n, n:] = price
        far[n:, :n] = np.where(flow.T > 0, -price.T, np.inf)
        for k in range(n + m):
            far = np.minimum(far, far[:, k : k + 1] + far[k : k + 1, :])
        assert (np.diag(far) >= 0).all()
        if cost is None:
            stays = sum(min(a, b) for a, b in zip(supply, demand))
            assert flow.sum() - np.trace(flow) == sum(supply) - stays


def brute_shards(rows, old, new):
    """Each old shard in falling size, cut where the middle of a row passes a run's end."""
    held = [[] for _ in range(old)]
    for r in rows:
        held[r[0] % old].append((len((r[1] or "").encode()) + 16, r[0]))
    for h in held:
        h.sort(key=lambda x: (-x[0], x[1]))
    total = sum(s for h in held for s, _ in h)
    flow = resharding.cheapest_flow([sum(s for s, _ in h) for h in held], resharding.equal_capacities(total, new))
    shards = [[] for _ in range(new)]
    got = defaultdict(list)
    for k, h in enumerate(held):
        order = sorted(np.flatnonzero(flow[k]).tolist(), key=lambda j: (j != k, j))
        ends = np.cumsum([flow[k, j] for j in order]).tolist()
        at = 0
        for size, doc_id in h:
            run = next((i for i, e in enumerate(ends[:-1]) if 2 * at + size < 2 * e), len(ends) - 1)
            got[order[run], k].append(doc_id)
            at += size
    for j in range(new):
        for k in sorted(range(old), key=lambda k: (k != j, k)):
            shards[j] += got[j, k]
    return {(doc_id, j, slot) for j, s in enumerate(shards) for slot, doc_id in enumerate(s)}


@pytest.mark.parametrize("old,new", [(3, 5), (6, 2), (4, 4)])
def test_resharding_moves_the_runs_of_the_flow(spark, old, new):
    rng = random.Random(old)
    rows = [(k, "é" * rng.choice([3, 40, 200, rng.randrange(300)]), "en", "a", 1) for k in range(150)] + [(150, None, None, None, None), (151, "", "", "", 0)]
    path = new_folder(spark, "test-shards")
    docs = table(spark, rows)
    found = resharding.resharded(docs, path, old, new, shard=F.col("doc_id") % old).collect()
    assert {(r.row.doc_id, r.shard, r.slot) for r in found} == brute_shards(rows, old, new) and len(found) == len(rows)
    assert {(r.row.doc_id, r.row.text) for r in found} == {(r[0], r[1]) for r in rows}
    assert found[0].row.asDict().keys() == set(docs.columns) and all(r.size == len((r.row.text or "").encode()) + 16 for r in found)
    stay = spark.read.parquet(f"{path}/manifest").where("stays").count()
    sizes = Counter()
    for r in found:
        sizes[r.shard] += r.size
    assert max(sizes.values()) - min(sizes.values()) < 700 and stay > 0


def test_resharding_of_repeated_rows_and_of_none(spark):
    docs = table(spark, [(None, "same text", "en", "a", 9)] * 40 + [(1, "long " * 400, "en", "a", 9)])
    found = resharding.resharded(docs, new_folder(spark, "test-shards"), 2, 4).collect()
    by_shard = defaultdict(list)
    for r in found:
        by_shard[r.shard].append(r.slot)
    assert len(found) == 41 and all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert resharding.resharded(docs.limit(0), new_folder(spark, "test-shards"), 2, 4).count() == 0
