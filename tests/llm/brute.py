"""Plain versions of the operators, over all rows and all pairs."""

import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from webloom.llm import mixing, quality


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return row[-1]


def substring_distance(p, t):
    col, best = list(range(len(p) + 1)), (len(p), 0)
    for at, c in enumerate(t, 1):
        new = [0]
        for i, x in enumerate(p):
            new.append(min(col[i] + (x != c), col[i + 1] + 1, new[-1] + 1))
        col = new
        best = min(best, (col[-1], at), key=lambda b: b[0])
    return best


class Sets:
    def __init__(self):
        self.above = {}

    def top(self, x):
        while self.above.get(x, x) != x:
            x = self.above[x]
        return x

    def join(self, a, b):
        a, b = self.top(a), self.top(b)
        self.above[max(a, b)] = min(a, b)


def quality_scores(spark, docs, labels):
    """doc_id and score: statistics letter by letter, the ridge by plain least squares, the calibration by all pools; over all rows."""
    def stats(t):
        data, n = t.encode(), max(1, len(t.encode()))
        kinds = [0] * 10
        for c in data:
            letter = chr(c)
            kind = 0 if "a" <= letter <= "z" or c >= 128 else 1 if "A" <= letter <= "Z" else 2 if letter.isdigit() else 4 if letter == "\n" else 3 if letter in " \t\v\f\r" else 9
            kinds[next((k for k, s in ((5, ".,;:'\"-"), (6, "#$%&*@^~"), (7, "!?"), (8, "|<>{}[]()\\/=_+")) if letter in s), kind)] += 1
        words, lines, letters = data.split(), data.split(b"\n"), kinds[0] + kinds[1]
        shares = [c / n for c in Counter(data).values()]
        w, d = max(1, len(words)), max(1, len(set(words)))
        return [math.log1p(len(data)), *(k / n for k in kinds), kinds[1] / max(1, letters), math.log1p(letters / w), math.log1p(len(data) / w), len(set(words)) / w,
                len(set(lines)) / len(lines), math.log1p(len(words) / d), -sum(p * math.log(p) for p in shares), math.log1p(len(words) / len(lines))]

    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    x = {i: stats(t) for i, t in texts.items()}
    label = {r.doc_id: r.quality for r in labels.collect()}
    known = [i for i in label if i in x and zlib.crc32(str(i).encode()) % 4 != 2]
    frame = spark.createDataFrame([(i, quality.statistics(texts[i].encode()).tolist()) for i in known], "doc_id long, x array<double>")
    draw = {r.doc_id: r.u for r in frame.select("doc_id", F.pmod(F.xxhash64(F.lit(7), "x"), F.lit(1 << 30)).alias("u")).collect()}
    fit, apart = [i for i in known if draw[i] % 5], [i for i in known if draw[i] % 5 == 0]
    every = np.array([x[i] for i in known])
    mean, spread = every.mean(axis=0), np.where(every.std(axis=0) > 1e-9, every.std(axis=0), 1)
    model = quality.Model(mean, spread, 4.0, 256, 7)
    z = lambda ids: np.array([np.append(np.cos(np.clip((np.array(x[i]) - mean) / spread, -8, 8) @ model.directions + model.phase) * math.sqrt(2 / 256), 1) for i in ids])
    a, y = z(fit), np.array([label[i] for i in fit], dtype=float)
    ridge = 1e-3 * len(fit) * np.array([1 / 256] * 256 + [1e-9])
    weights = np.linalg.lstsq(np.vstack([a, np.diag(np.sqrt(ridge))]), np.concatenate([y, np.zeros(257)]), rcond=None)[0]
    raw, y = z(apart) @ weights, np.array([label[i] for i in apart], dtype=float)
    order = np.argsort(raw)
    raw, y = raw[order], y[order]
    n = len(y)
    # The isotonic fit: the largest mean from below of the least means to above.
    sums = np.concatenate([[0], np.cumsum(y)])
    level = [max(min((sums[v + 1] - sums[u]) / (v + 1 - u) for v in range(k, n)) for u in range(k + 1)) for k in range(n)]
    places = [np.mean([raw[k] for k in range(n) if abs(level[k] - v) < 1e-12]) for v in sorted(set(np.round(level, 12)))]
    scores = np.clip(np.interp(z(sorted(x)) @ weights, places, sorted(set(np.round(level, 12)))), 0, 1)
    return dict(zip(sorted(x), scores.tolist(), strict=True))


def seats(n, votes, caps):
    won = [0] * len(votes)
    for _ in range(n):
        won[max((i for i in range(len(votes)) if won[i] < caps[i]), key=lambda i: (votes[i] / (2 * won[i] + 1), -i))] += 1
    return won


def taken_words(docs, seed=17, block=1024, per_shard=2_000_000):
    """Seats given one by one, blocks counted word by word."""
    rows = [(x.doc_id, x.text, x.source) for x in docs.collect()]
    size = {i: len((t or "").encode().split()) for i, t, _ in rows}
    of = {s: sum(size[i] for i, _, x in rows if x == s) for s in sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))}
    weights = [(3, 1, 2)[k % 3] for k in range(len(of))]
    targets = mixing.share_out(1.5 * sum(of.values()), weights, [2 * n for n in of.values()])
    block = max(1, min(block, int(min(t for t in targets if t > 0) / 200)))
    quotas = seats(round(sum(targets) / block), targets, [-(-2 * n // block) for n in of.values()])
    placed = docs.select("doc_id", F.xxhash64(F.lit(seed), "doc_id", F.coalesce("text", F.lit(""))).alias("place")).withColumn("at", F.xxhash64(F.lit(seed + 1), "place")).collect()
    place, wanted = {x.doc_id: (x.place, x["at"]) for x in placed}, {}
    for (s, n), quota in zip(of.items(), quotas, strict=True):
        shards = max(1, -(-n // per_shard))
        held = [sorted((place[i][0], i) for i, _, x in rows if x == s and place[i][1] % shards == k) for k in range(shards)]
        sizes = [sum(size[i] for _, i in h) for h in held]
        for k, (h, m, q) in enumerate(zip(held, sizes, seats(quota, sizes, [-(-2 * m // block) for m in sizes]), strict=True)):
            passes, rest = divmod(min(q * block, 2 * m), m) if m else (0, 0)
            blocks, picked, factor, shift = mixing.chosen_blocks(seed, s, k, m, block, rest)
            taken = set(sorted(range(blocks), key=lambda b: (b * factor + shift) % blocks)[:picked])
            word = 0
            for _, i in h:
                wanted[i] = passes * size[i] + sum(w // block in taken for w in range(word, word + size[i]))
                word += size[i]
    return wanted


def near(a, b, most):
    """Whether two strings are within so many edits; strings of too different lengths or letters aren't compared."""
    if abs(len(a) - len(b)) > most or sum((Counter(a) - Counter(b)).values()) > most or sum((Counter(b) - Counter(a)).values()) > most:
        return False
    return distance(a, b) <= most


def kept_lines(rows):
    """The texts of (doc_id, text), in order of doc_id, without lines that an earlier one repeats within its edits."""
    lines = [(d, i, x) for d, t in rows for i, line in enumerate(t.split("\n")) if (x := line.strip().lower())]
    distinct, sets, first, gone = sorted({x for _, _, x in lines}), Sets(), {}, set()
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if near(a, b, min(2, min(len(a), len(b)) // 10)):
                sets.join(a, b)
    for d, i, x in lines:
        if first.setdefault(sets.top(x), (d, i)) != (d, i):
            gone.add((d, i))
    return [(d, "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone)) for d, t in rows]


def one_of_each(rows, words, percent):
    """The ids of rows (doc_id, text), in order of doc_id, that are the first of their component; rows without words are."""
    shingles, sets = [], Sets()
    for i, (_, t) in enumerate(rows):
        w = t.lower().encode().split()
        s = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
        for j, b in enumerate(shingles):
            if s and b and 100 * len(s & b) >= percent * len(s | b):
                sets.join(i, j)
        shingles.append(s)
    return [d for i, (d, _) in enumerate(rows) if sets.top(i) == i]


def holds(text, item, rate=0.08):
    plain = lambda x: " ".join(x.lower().split())
    return substring_distance(plain(item), plain(text))[0] <= int(rate * len(plain(item)))
