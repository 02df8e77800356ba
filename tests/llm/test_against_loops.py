"""Models and recall against plain loops."""

import math
import random

import numpy as np
import pytest
from brute import components

from granary.llm import linear, near, quality


def weight(z, n, m):
    return 0.0 if abs(z) <= m.l1 else -(z - math.copysign(m.l1, z)) / ((m.beta + math.sqrt(n)) / m.alpha + m.l2)


def learned(x, y, width, m, seed=7):
    """FTRL-Proximal with one number at a time: weights by feature (the last is the bias) and class."""
    k = len(m.classes)
    z, n = ([[0.0] * k for _ in range(width + 1)] for _ in range(2))
    rows = np.array([i for i in range(len(x)) if i % 5 != 4])
    rng = np.random.default_rng(seed)
    for _ in range(m.epochs):
        for i in rng.permutation(rows):
            active = [*zip(x[i][0].tolist(), x[i][1].tolist()), (width, 1.0)]
            w = {f: [weight(z[f][c], n[f][c], m) for c in range(k)] for f, _ in active}
            score = [sum(v * w[f][c] for f, v in active) for c in range(k)]
            e = [math.exp(s - max(score)) for s in score]
            for f, v in active:
                for c in range(k):
                    g = v * (e[c] / sum(e) - (c == y[i]))
                    z[f][c] += g - (math.sqrt(n[f][c] + g * g) - math.sqrt(n[f][c])) / m.alpha * w[f][c]
                    n[f][c] += g * g
    return np.array([[weight(a, b, m) for a, b in zip(p, q)] for p, q in zip(z, n)])


@pytest.mark.parametrize("classes, l1", [(2, 0.02), (4, 0.3)])
def test_follow_the_regularised_leader(classes, l1):
    g = np.random.default_rng(classes)
    width, y = 30, g.integers(0, classes, 50)
    x = []
    for c in y:
        at = np.unique(np.append(g.choice(width, 5, False), c))
        x.append((at, g.random(len(at)).astype(np.float32)))
    m = linear.Model(list(range(classes)), l1=l1).fit(x, y, width)
    want = learned(x, y, width, m)
    assert np.allclose(m.weights, want[:-1], atol=1e-5) and np.allclose(m.bias, want[-1], atol=1e-5)
    assert ((m.weights == 0) == (want[:-1] == 0)).all() and (m.weights == 0).any() == (l1 > 0.1)  # the penalty makes zeros where the loop has them

    def loss(t):
        out = 0.0
        for i in range(4, 50, 5):
            s = [(sum(v * want[f, c] for f, v in zip(*x[i])) + want[-1, c]) / t for c in range(classes)]
            out -= s[y[i]] - math.log(sum(map(math.exp, s)))
        return out

    assert loss(m.temperature) <= min(map(loss, np.exp(np.linspace(math.log(0.3), math.log(20), 40)))) + 0.01


def prior(groups, centre):
    """groups: (documents, sum of probabilities, centre of its own or None)."""
    many = [(n, s, centre if c is None else c) for n, s, c in groups if n > 1]
    total = sum(n for n, _, _ in many)
    chance = sum(n * c * (1 - c) for n, _, c in many)
    if len(many) < 2 or not chance:
        return quality.STRONGEST
    between = (sum(n * (s / n - c) ** 2 for n, s, c in many) - chance * len(many) / total) / total
    return min(quality.STRONGEST, max(quality.WEAKEST, chance / total / between - 1)) if between > 0 else quality.STRONGEST


def test_posteriors_of_hosts_and_paths(spark):
    r = random.Random(5)
    rows = [(i, ("fine words here " if r.random() < (i % 7) / 8 + 0.05 else "bad ### ") * r.randrange(1, 4), f"h{i % 7}" if i % 50 else None, r.choice(["a", "b", None])) for i in range(300)]
    docs = spark.createDataFrame(rows + [(300, "fine words here", "alone", "a")], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, int("fine" in t), 0) for i, t, _, _ in rows[:200]], "doc_id long, quality int, toxic int")
    out = {x.doc_id: x for x in quality.quality(docs, labels).collect()}
    site = {d: (h or "", p or "") for d, _, h, p in docs.collect()}
    p = {d: x.p_doc for d, x in out.items()}
    assert len(out) == 301 and len({round(v, 3) for v in p.values()}) > 1
    centre = sum(p.values()) / len(p)
    hosts, paths = {}, {}
    for d, (h, path) in site.items():
        for table, key in ((hosts, h), (paths, (h, path))):
            n, s = table.get(key, (0, 0.0))
            table[key] = (n + 1, s + p[d])
    k = prior([(n, s, None) for n, s in hosts.values()], centre)
    host = {h: (s + k * centre) / (n + k) for h, (n, s) in hosts.items()}
    k = prior([(n, s, host[h]) for (h, _), (n, s) in paths.items()], None)
    odds = lambda q: math.log(min(max(q, quality.EDGE), 1 - quality.EDGE) / (1 - min(max(q, quality.EDGE), 1 - quality.EDGE)))
    for d, x in out.items():
        n, s = paths[site[d]]
        own = (s - p[d] + k * host[site[d][0]]) / (n - 1 + k)
        score = 1 / (1 + math.exp(-(odds(p[d]) + odds(own) - odds(centre))))
        assert x.p_host == pytest.approx(host[site[d][0]], abs=1e-6) and x.score == pytest.approx(score, abs=1e-6)
        assert x.kept == (x.score >= 0.5 and not x.toxic)


def test_recall_just_above_the_threshold(spark):
    """1,500 pairs of texts, most of a similarity of 0.80 to 0.85: each link there is has to be found."""
    r, docs = random.Random(23), []
    for i in range(1500):
        w = [f"v{r.randrange(5000)}" for _ in range(r.randrange(60, 160))]
        other = list(w)
        for at in r.sample(range(len(w)), max(1, round(len(w) * r.uniform(0.017, 0.028)))):
            other[at] = f"n{r.random()}"
        docs += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(other))]

    def sets(t):
        w = t.split()
        return {tuple(w[k : k + 4]) for k in range(len(w) - 3)}

    similar = []
    for (_, a), (_, b) in zip(docs[::2], docs[1::2]):
        a, b = sets(a), sets(b)
        similar.append(len(a & b) / len(a | b))
    assert sum(0.8 <= s <= 0.85 for s in similar) > 300 and sum(s < 0.8 for s in similar) > 100
    got = near.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 4)
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got.collect()) == sorted(components(docs))
