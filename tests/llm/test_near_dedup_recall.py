"""Classes of near copies against the exact weighted Jaccard similarity of all pairs that share a shingle, inverse frequencies on."""

import math
from collections import Counter, defaultdict

import duckdb

from ziplore.llm import near_dedup
from ziplore.llm.queries import op6_near_dedup

SF = "/root/testdata/sf0.01"


def bag(text):
    words = (text or "").encode().split()
    n = min(5, len(words))
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if n else Counter()


def exact_links(docs, threshold):
    """Pairs at or above the threshold, with counted document frequencies."""
    bags = {i: bag(t) for i, t in docs}
    rows = sum(bool(b) for b in bags.values())
    frequency = Counter(s for b in bags.values() for s in b)

    def weight(shingle, times):
        share = frequency[shingle] / rows
        idf = 1 - near_dedup.DAMPING * math.log(share / near_dedup.RARE) / math.log(1 / near_dedup.RARE) if share > near_dedup.RARE else 1.0
        return (1 + math.log(times)) * idf

    weights = {i: {s: weight(s, n) for s, n in b.items()} for i, b in bags.items()}
    total = {i: sum(w.values()) for i, w in weights.items()}
    holders = defaultdict(list)
    for i, b in bags.items():
        for s in b:
            holders[s].append(i)
    both = Counter()
    for s, ids in holders.items():
        for x in range(len(ids)):
            for y in range(x):
                both[ids[y], ids[x]] += min(weights[ids[y]][s], weights[ids[x]][s])
    return {p: v / (total[p[0]] + total[p[1]] - v) for p, v in both.items() if v / (total[p[0]] + total[p[1]] - v) >= threshold}


def test_recall_and_precision_of_links(spark):
    docs = duckdb.connect().execute(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()
    links = exact_links(docs, near_dedup.THRESHOLD)
    cluster = {r.doc_id: r.cluster_id for r in op6_near_dedup(spark, SF).collect()}
    found = sum(cluster[a] == cluster[b] for a, b in links)
    assert len(links) > 50
    assert found / len(links) >= 0.99
    # Nothing is together that no chain of links joins; frequencies are counted in hashed counters, hence the slack.
    parent = {i: i for i, _ in docs}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in exact_links(docs, near_dedup.THRESHOLD - 0.01):
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    assert all(root(i) == root(c) for i, c in cluster.items())
