"""Prefix tries, secret scans and spelling variants against plain versions, on odd, repeated, split and empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import cache

import pytest

from brute import number, sha
from odd import SMALL, empty, odd, odd_rows, small_rows  # noqa: F401  fixtures
from pagemill.llm import credentials, queries, spelling, tries

# --- prefix tries -----------------------------------------------------------------------------------


def plain_trie(rows, group=100, heads=6):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append(((turn is not None, turn or 0), hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), (role, text)))
    own = {c: [t for _, _, t in sorted(x)] for c, x in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        base = c - int(math.fmod(c, group))
        h = zlib.crc32(str(c).encode()) % heads
        rebuilt = own[c] if c == base else own.get(base, [])[:h] + own[c][h:]
        for d in range(len(rebuilt) + 1):
            members[tuple(rebuilt[:d])].append(c)
        ends[tuple(rebuilt)].append(c)
    children, leaves, saved = Counter(p[:-1] for p in members if p), Counter(), Counter()
    for p, ids in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(ids) - 1) * len(p[-1][1]) if p else 0
    return Counter((ids[0], len(p), members[p[:-1]][0] if p else None, len(ids), children[p], leaves[p], saved[p], sha(",".join(map(str, ends[p])))) for p, ids in members.items())


def odd_turns():
    rng = random.Random(11)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(["yes", "no", "perhaps, who knows"])) for c in [*range(-3, 30), 100, 101, 102, 205, 299, 300] for t in range(rng.randint(1, 9))]
    rows += [(7, None, "system", "first of all"), (7, None, None, None), (8, 2, None, ""), (8, 2, "", None), (9, 0, "user", "é" * 3000), (None, 0, "user", "nobody's"), (9, 0, "user", "é" * 3000)]
    rows += [(100, t, "user", f"long {t % 7}") for t in range(20, 200)] + [(103, t, "user", f"long {t % 7}") for t in range(20, 260)] + [(104, 1, "user", "yes")] * 60
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("parts", [1, 4, 37])
def test_tries_of_odd_turns(spark, parts):
    rows = odd_turns()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", k1 int, depth string").repartition(3)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        for k, v in zip(before, (str(parts), "false", "5")):  # a partition then holds a few turns, and conversations cross many
            spark.conf.set(k, v)
        found = tries.trie(docs).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert Counter(tuple(r)[:8] for r in found) == plain_trie(rows)
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0), hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest()))
    assert all((r["turn_conv"] is None) == (r["depth"] == 0) and (r["depth"] == 0 or 0 <= r["turn_at"] < len(own[r["turn_conv"]])) for r in found)


def test_tries_other_groups_and_heads(spark):
    rows = odd_turns()[:120]
    found = tries.trie(spark.createDataFrame(rows, SCHEMA), group=7, heads=3).collect()
    assert Counter(tuple(r)[:8] for r in found) == plain_trie(rows, 7, 3)


def test_trie_of_nothing(spark, tmp_path):
    for i, rows in enumerate(([], [(None, 1, "user", "x")])):
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/{i}/conversations.parquet")
        assert queries.QUERIES["op11_prefix_trie"](spark, f"{tmp_path}/{i}").collect() == []


def test_products_are_a_group():
    rng = random.Random(2)
    maps = [tries.turn_map(rng.randbytes(32)) for _ in range(9)]
    whole = tries.NOTHING
    for m in maps:
        whole = tries.then(whole, m)
    head, tail = tries.then(maps[0], maps[1]), tries.NOTHING
    for m in maps[2:]:
        tail = tries.then(tail, m)
    assert tries.then(head, tail) == whole and tries.then(tries.undone(head), whole) == tail
    assert tries.then(maps[0], maps[1]) != tries.then(maps[1], maps[0])


# --- secrets ----------------------------------------------------------------------------------------


def base_spans(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.ASCII | re.IGNORECASE) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


def written(spans):
    return ",".join(f"{credentials.KINDS[k]}:{a}:{b}" for a, k, b in spans)


SECRETS = [
    "password=b7db7aa4a5fcc78305 x", 'é ü API_KEY"  :  \'abc.DEF+12/=_-\' tail', "token: short", "password: token: abcdefghij", "secret=secret=abcdefgh12", "AKIAKIA12345678901 AKIA12", "AKIAAKIAAKIAAKIA1",
    "0" * 31 + " " + "ab" * 20 + "G" + "f" * 32, "pwd := letmein123", "ſecret=abcdefgh1 toKen=abcdefgh1", "日本 passphrase => kT9#mQ2x!vb \"q", "compass=kT9#mQ2xvb77", "token bearer eyJhbGciOiJIUzI1NiJ9.e30.abc-def",
    "password=" + "aB3$" * 5000, "client_secret='P@ssw0rd2019'", "apikey=" + "0123456789abcdef" * 4, "", None,
]


def test_secrets_of_odd_rows(spark, odd, odd_rows, tmp_path):
    rows = [(r[0], r[1]) for r in odd_rows] + list(enumerate(SECRETS, 100)) + [(100, SECRETS[0])] * 2 + [(None, SECRETS[0])]
    spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, secrets int").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.QUERIES["op12_secrets"](spark, str(tmp_path)).collect()
    expected = Counter()
    for doc_id, text in rows:
        base = base_spans(text or "")
        kinds = Counter(k for _, k, _ in base)
        expected[doc_id, kinds[0], kinds[1], kinds[2], sha(written(base))] += 1
    assert Counter(tuple(r)[:4] + (r["base_sha256"],) for r in found) == expected
    texts = defaultdict(set)
    for doc_id, text in rows:
        texts[doc_id].add(text or "")
    for r in found:  # base spans stay, in order, among the others
        spans = [s.split(":") for s in r["spans"].split(",") if s]
        assert spans == sorted(spans, key=lambda s: (int(s[1]), credentials.KINDS.index(s[0])))
        assert sha(",".join(":".join(s) for s in spans if s[0] != "guess")) == r["base_sha256"] and r["n_guess"] == sum(s[0] == "guess" for s in spans)
        if len(texts[r["doc_id"]]) == 1:
            (text,) = texts[r["doc_id"]]
            for kind, a, b in spans:
                if kind == "guess":
                    value = text[int(a) : int(b)]
                    assert len(value) >= 8 and not set(value) & set(" \t\n\"',;<>") and (len(value) > 100 or plain_cost(value) >= credentials.LEAST)


@pytest.mark.parametrize("text,value", [
    ("password=b7db7aa4a5fcc78305 x", "b7db7aa4a5fcc78305"), ("日本 passphrase => kT9#mQ2x!vb \"q", "kT9#mQ2x!vb"), ("token bearer eyJhbGciOiJIUzI1NiJ9.e30", "eyJhbGciOiJIUzI1NiJ9.e30"),
    ("pwd := letmein123", None), ("client_secret='P@ssw0rd2019'", None), ("compass=kT9#mQ2xvb77", None), ("password: qwertyuiop[]", None), ("the secret: something", None), ("password=20191231", None), ("secret=abcabcabcabcabc", None)])
def test_values_that_take_many_guesses(text, value):
    assert [text[a:b] for a, k, b, _ in credentials.spans_of(text) if k == 3] == ([value] if value else [])


def plain_segments(value, repeats=True):
    """All segments, each judged by itself."""
    low, n, log2 = value.lower(), len(value), math.log10(2)
    plain = "".join(credentials.ALIKE.get(c, c) for c in low)

    def case(part):
        upper, letters = sum(c.isupper() for c in part), sum(c.isalpha() for c in part)
        return 0 if not upper else log2 if upper == letters or upper == 1 and part[0].isupper() else log2 * min(upper, letters - upper)

    near = lambda a, b: a in credentials._PLACE and b in credentials._PLACE and a != b and (
        abs(credentials._PLACE[a][0] - credentials._PLACE[b][0]) == 1 / (1 + abs(credentials._PLACE[a][1] - credentials._PLACE[b][1]))
        and abs(credentials._PLACE[a][1] - credentials._PLACE[b][1]) <= 1)
    for i in range(n):
        for j in range(i + 1, n + 1):
            part, signs = value[i:j], sum(a != b for a, b in zip(low[i:j], plain[i:j]))
            for word, more in ((low[i:j], 0), (plain[i:j], signs), (plain[i:j][::-1], signs + 1)):
                if word in credentials.WORDS:
                    yield i, j, math.log10(credentials.WORDS.index(word) + 1) + more * log2 + case(part)
            alone = (i == 0 or not ("a" <= low[i - 1] <= "z")) and (j == n or not ("a" <= low[j] <= "z"))
            if alone and 4 <= j - i <= 15 and all("a" <= c <= "z" for c in low[i:j]) and all(set(low[k : k + 5]) & set("aeiouy") for k in range(i, j - 4)):
                yield i, j, credentials.UNKNOWN_WORD + case(part)
            if re.fullmatch(r"(19|20)\d\d", part):
                yield i, j, math.log10(credentials.YEARS)
            for order in ("ymd", "dmy", "mdy"):
                m = re.fullmatch(r"([-/._]?)".join([r"(?P<y>(?:19|20)\d\d)" if f == "y" else rf"(?P<{f}>\d\d)" for f in order]), part)
                if m and 1 <= int(m["m"]) <= 12 and 1 <= int(m["d"]) <= 31:
                    first, second = (m.group(g) for g in sorted(set(range(1, 6)) - {m.re.groupindex[f] for f in order}))
                    if first == second:
                        yield i, j, math.log10(credentials.YEARS * 372 * (4 if first else 1))
            whole = all(near(a, b) for a, b in zip(low[i:j], low[i + 1 : j]))
            if j - i >= 3 and whole and (i == 0 or not near(low[i - 1], low[i])) and (j == n or not near(low[j - 1], low[j])):
                ways = [(credentials._PLACE[b][0] - credentials._PLACE[a][0], credentials._PLACE[b][1] - credentials._PLACE[a][1]) for a, b in zip(low[i:j], low[i + 1 : j])]
                turns = 1 + sum(a != b for a, b in zip(ways, ways[1:]))
                yield i, j, math.log10(len(credentials._PLACE) * (j - i)) + turns * math.log10(6) + case(part)
            for unit in range(1, 9) if repeats else ():
                times = (j - i) // unit
                if times * unit == j - i >= 3 and times >= 2 and part == value[i : i + unit] * times and value[j : j + unit] != value[i : i + unit]:
                    if i == 0 or unit > n - i or value[i - 1] != value[i + unit - 1]:
                        yield i, j, plain_cost(value[i : i + unit], False) + math.log10(times)


def plain_cost(value, repeats=True):
    """Every segmentation is tried."""
    by = defaultdict(list)
    for a, b, cost in plain_segments(value, repeats):
        by[a].append((b, cost))

    @cache
    def rest(i):
        if i == len(value):
            return 0.0
        options, brute = [cost + rest(b) for b, cost in by[i]], 0.0
        for j in range(i, len(value)):
            brute += math.log10(10 if value[j].isdigit() else 26 if value[j].isalpha() else 33)
            options.append(brute + rest(j + 1))
        return credentials.STEP + min(options)

    return rest(0)


def test_guess_costs_are_the_least_of_all_segmentations():
    rng = random.Random(6)
    pieces = ["password", "P4ssw0rd", "drowssap", "2019", "31-12-1999", "19991231", "12.31.2001", "qwerty", "zxcvfr", "aaa", "abab", "xyzxyz", "Thation", "bcdfg", "7", "kT", "#", "_", "LOVE", "1q2w", "[]"]
    for _ in range(400):
        value = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 3)))
        assert credentials.guess_cost(value) == pytest.approx(plain_cost(value), abs=1e-9), value


def test_long_values_take_linear_time():
    assert credentials.guess_cost("aB3$" * 200_000) < 13 < credentials.guess_cost("".join(random.Random(1).choices("abcdefghij0123456789#", k=50_000)))


# --- spelling ---------------------------------------------------------------------------------------


def plain_variants(rows, every=199, least=5, ratio=5, min_chars=6):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if every and h % every == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            count[word] += 1
    words = {w: n for w, n in count.items() if len(w) >= min_chars and n >= least}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out = {}
    for w, n in words.items():
        others = [x for x in words if x != w and abs(len(x) - len(w)) <= 1 and near(w, x)]
        best = min(others, key=lambda x: (-words[x], x), default=None)
        out[w] = (best if best is not None and words[best] >= ratio * n else None, n, len(others))
    found = Counter()
    for w, (form, n, others) in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        found[w, form, root, n, others, words[form] if form else None] += 1
    return found


def spelled(rng, size):
    base = ["".join(rng.choices("abcé", k=rng.randint(5, 9))) for _ in range(40)] + ["zzzzzz", "zzzzzzz", "zzzzzzzz", "abcabcabcabcabcabcabcabc", "÷×ÿabcd", "ABCDEFÉ"]
    words = []
    for w in base:
        n = rng.choice([5, 6, 30, 160])
        words += [w] * n
        for _ in range(rng.randint(0, 4)):
            i = rng.randrange(len(w))
            words += [rng.choice([w[:i] + w[i + 1 :], w[:i] + "b" + w[i:], w[:i] + "c" + w[i + 1 :]])] * rng.choice([5, 1, 7])
    rng.shuffle(words)
    return [(i, " ".join(words[i::size])) for i in range(size)]


@pytest.mark.parametrize("crowd,chunk", [(100_000, 20_000), (100_000, 1), (3, 50), (0, 1)])
def test_near_words_whatever_the_lists(spark, crowd, chunk):
    rows = spelled(random.Random(5), 30) + [(None, "Wanderer wanderer wanderer wanderer wanderer"), (3, None), (4, ""), (5, "12 34 !!"), (7, "zzzzzz " * 200), (7, "zzzzzz " * 200)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, word int").repartition(4)
    assert Counter(map(tuple, spelling.variants(docs, crowd=crowd, chunk=chunk).collect())) == plain_variants(rows)


@pytest.mark.parametrize("every,least", [(0, 1), (3, 2)])
def test_other_settings(spark, every, least):
    rows = spelled(random.Random(8), 10)
    found = spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"), every=every, min_count=least, min_chars=4, ratio=2).collect()
    assert Counter(map(tuple, found)) == plain_variants(rows, every, least, 2, 4)


def test_words_of_odd_rows(spark, odd, odd_rows):
    assert Counter(map(tuple, queries.QUERIES["op13_spelling"](spark, odd).collect())) == plain_variants([(r[0], r[1]) for r in odd_rows])


# --- earlier operators ------------------------------------------------------------------------------


def test_a_labeller_that_blames_good_documents_is_found_out():
    import numpy as np
    from pagemill.llm import quality
    rng = np.random.default_rng(5)
    n, k = 60_000, len(quality.LABELLERS)
    good = rng.random(n) < 0.9
    hit, false = np.array([0.3, 0.4, 0.5, 0.6, 0.7, 0.35]), np.array([0.002] * (k - 1) + [0.05])
    votes = np.where(rng.random((n, k)) < np.where(good[:, None], false, hit), quality.BAD, quality.GOOD)
    patterns, counts = np.unique(quality.patterns_of(votes), return_counts=True)
    labels = quality.Labels(patterns, counts.astype(float))
    assert labels.shares[quality.GOOD, -1, quality.BAD] == pytest.approx(0.05, abs=0.005) and labels.good == pytest.approx(0.9, abs=0.01)
    only = good & (votes[:, -1] == quality.BAD) & (votes[:, :-1] == quality.GOOD).all(axis=1)
    assert only.sum() > 2000 and (labels.posterior(quality.patterns_of(votes))[only] > 0.5).all()


def test_weak_labels_and_scorer_by_plain_loops():
    import numpy as np
    from pagemill.llm import quality
    rng = np.random.default_rng(2)
    votes = rng.choice([0, 1, 2], (300, len(quality.LABELLERS)), p=[0.2, 0.7, 0.1])
    patterns, counts = np.unique(quality.patterns_of(votes), return_counts=True)
    rounds = 12
    labels = quality.Labels(patterns, counts.astype(float), rounds)
    share, vote = 0.9, {(c, j, v): [(0.4, 0.6), (0.002, 0.998)][c][v] for c in (0, 1) for j in range(6) for v in (0, 1)}

    def chance(row):
        odds = [1 - share, share]
        for c in (0, 1):
            for j, v in enumerate(row):
                odds[c] *= vote[c, j, int(v)] if v < 2 else 1
        return odds[1] / sum(odds)

    for _ in range(rounds):
        found = [chance(row) for row in votes]
        weight = [sum(1 - p for p in found), sum(found)]
        share = (weight[1] + 1) / (len(votes) + 2)
        for c in (0, 1):
            for j in range(6):
                own = [sum((p if c else 1 - p) for p, row in zip(found, votes) if row[j] == v) + [(0.4, 0.6), (0.002, 0.998)][c][v] * (quality.PRIOR * weight[c] + 0.1) for v in (0, 1)]
                for v in (0, 1):
                    vote[c, j, v] = own[v] / sum(own)
    assert labels.good == pytest.approx(share) and labels.posterior(quality.patterns_of(votes[:50])).tolist() == pytest.approx([chance(r) if (r < 2).any() else share for r in votes[:50]])
    x, y = rng.random((40, 5)).astype(np.float32), rng.random(40)
    scorer = quality.Scorer(x, y, 0.7, rounds=30)
    w, bias, speed = [0.0] * 5, math.log(0.7 / 0.3), [0.0] * 5
    many = [sum(v > 0.5 for v in y), sum(v <= 0.5 for v in y)]
    for _ in range(30):
        error = [(1 / (1 + math.exp(-(sum(a * b for a, b in zip(row, w)) + bias))) - t) * 0.5 / many[0 if t > 0.5 else 1] for row, t in zip(x.tolist(), y)]
        for i in range(5):
            speed[i] = 0.9 * speed[i] - 4.0 * (sum(e * row[i] for e, row in zip(error, x.tolist())) + 1e-6 * w[i])
        w = [a + b for a, b in zip(w, speed)]
    assert scorer.weights.tolist() == pytest.approx(w, rel=1e-3, abs=1e-4)


def test_mixing_does_not_move_texts_to_their_sources(spark, monkeypatch):
    from pagemill.llm import mixing
    docs = spark.createDataFrame([(i, f"s{i % 3}" if i % 5 else None, "x" * (i % 7)) for i in range(300)], "doc_id long, source string, text string")
    held = mixing.mix(docs)
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    monkeypatch.setattr(mixing, "HELD", 0)
    assert Counter(map(tuple, mixing.mix(docs).collect())) == Counter(map(tuple, held.collect()))
    monkeypatch.undo()
    assert mixing.mix(docs).select("doc_id").count() == held.count() == mixing.mix(docs.select("doc_id", "source", "text")).select("doc_id").count()


def test_broken_files_are_rows(spark):
    from pagemill.llm import jpeg, media
    rng, good = random.Random(7), jpeg.store(b"some bytes" * 60)
    files = []
    for i in range(300):
        raw = bytearray(good)
        for _ in range(3):
            raw[rng.randrange(min(700, len(raw)))] = rng.randrange(256)
        files.append((i, bytes(raw)))
    at = good.index(b"\xff\xc2")
    huge, flat = bytearray(good), bytearray(good)
    huge[at + 5 : at + 9] = b"\xff\xff\xff\xff"
    flat[at + 11] = 0
    table = good.index(b"\xff\xc4")
    size = int.from_bytes(good[table + 2 : table + 4], "big")
    files += [(300, bytes(huge)), (301, bytes(flat)), (302, good[:table] + good[table + 2 + size :]), (303, good)]
    frame = spark.createDataFrame([(i, bytearray(f), 5, "x") for i, f in files], "id long, media binary, height int, problem string")
    read = media.read_media(frame, with_payload=True)
    assert read.columns == ["id", "media", "height", "problem", "_height", "width", "rgb", "feature", "payload", "_problem"]
    rows = {r["id"]: r for r in read.collect()}
    assert len(rows) == 304 and all((r["_problem"] is None) == (r["rgb"] is not None) for r in rows.values())
    assert "pixels" in rows[300]["_problem"] and "factors" in rows[301]["_problem"] and rows[302]["_problem"] and rows[303]["payload"].startswith(b"some bytes")


def test_colours_of_three_and_four_components():
    import numpy as np
    from pagemill.llm import jpeg
    image = jpeg.Image.__new__(jpeg.Image)
    image.height = image.width = image.h = image.v = 1
    image.components = [jpeg.Component(i, 1, 1, 0) for i in range(4)]
    planes = [np.full((1, 1), x, np.uint8) for x in (200, 100, 50, 128)]
    image.planes = lambda: planes[: len(image.components)]
    image.transform = 0
    assert image.rgb().ravel().tolist() == [100, 50, 25]  # ink left out
    image.transform = None
    assert image.rgb().ravel().tolist() == [(55 * 127 + 127) // 255, (155 * 127 + 127) // 255, (205 * 127 + 127) // 255]
    image.components = image.components[:3]
    image.transform = 0
    assert image.rgb().ravel().tolist() == [200, 100, 50]
    image.transform = None
    assert image.rgb().ravel().tolist() == [91, 255, 150]


def plain_languages(train, texts, longest=4):
    words, grams = defaultdict(Counter), defaultdict(Counter)
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t.lower())
    runs = lambda w, n: [f" {w} "[i : i + n] for i in range(max(1, len(w) + 3 - n))]
    for text, lang in train:
        for w in split(text):
            words[w][lang] += 1
    for w, by in words.items():
        for lang, n in by.items():
            for size in range(1, longest + 1):
                for g in runs(w, size):
                    grams[g][lang] += n
    langs = sorted({lang for by in words.values() for lang in by})
    share = lambda table: {k: [math.log((by[x] + 0.5) / sum(o[x] + 0.5 for o in table.values())) for x in langs] for k, by in table.items()}
    words, grams = share(words), share(grams)
    out = []
    for text in texts:
        if text is None or not any(c.isalpha() for c in text):
            out.append(("und", 0.0))
            continue
        total = [0.0] * len(langs)
        for w in split(text):
            logs = words.get(w)
            for size in range(min(longest, len(w) + 2), 0, -1):
                if logs is None and (known := [grams[g] for g in runs(w, size) if g in grams]):
                    logs = [sum(x) / len(known) for x in zip(*known)]
            total = [a + b for a, b in zip(total, logs or [0.0] * len(langs))]
        best = max(range(len(langs)), key=lambda i: (total[i], -i))
        out.append((langs[best], 1 / sum(math.exp(t - total[best]) for t in total)))
    return out


def test_languages_by_plain_loops(spark):
    from pagemill.llm import language
    train = [("the cat sat on the mat", "en"), ("die Katze sa\u00df auf der Matte\u00a0: ja", "de"), ("le chat \u2014 oui\u3000non", "fr"), ("the dog\x1cran", "en"), ("der Hund", "de")]
    texts = ["the Matte", "Katzen hunde", "chats oui\u3000non", "a\u00a0b the", "qqq zzz", "12 !!", None, "", "dog\x1cran der", "x" * 3000 + " der die", "\u00df"]
    model = language.fit(spark.createDataFrame([(i, *r) for i, r in enumerate(train)], "doc_id long, text string, lang string"))
    assert len(model.words) == len({w for t, _ in train for w in re.findall(r"[^\x20\x09-\x0D]+", t.lower())})  # none is left out
    scorer = language.Scorer(model)
    for got, want in zip(map(scorer.predict, texts), plain_languages(train, texts)):
        assert got[0] == want[0] and got[1] == pytest.approx(want[1], rel=1e-4)
