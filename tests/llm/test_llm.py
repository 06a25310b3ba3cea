import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from breachline.llm import bytescan, chat, exact_dedup, line_dedup, mixing, near_dedup, packing, pii, quality_classifier, quality_rules, suffix_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long, `_text` string, node string, run string"
WORDS = "the quick brown fox jumps over a lazy dog while seven wizards brew strong potions under pale moonlight near old stone bridges and quiet rivers".split()


def prose(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def corpus():
    """Nulls, empty and long texts, ties, repeated rows, near and exact copies; columns whose names clash."""
    r = random.Random(4)
    rows = [(i, prose(r, r.randint(3, 160)), f"src{i % 4}") for i in range(60)]
    base = rows[0][1] + " " + prose(r, 120)
    for i in range(60, 90):
        w = base.split()
        for _ in range(r.randint(0, 8)):
            w[r.randrange(len(w))] = r.choice(["changed", "words"])
        rows.append((i, " ".join(w), "src0"))
    line = "All rights reserved by the owner of this page 2021."
    rows += [(i, f"{prose(r, 60)}\n{line.replace('2021', str(1990 + i))}\n{prose(r, 30)}", None) for i in range(90, 100)]
    rows += [(100, None, "src1"), (101, "", None), (102, " \t\n", "src2"), (103, rows[5][1], "src2"), (104, rows[5][1] + "  ", "src2"), (105, "Ab c", "src9"), (106, "aB C", "src9")]
    rows += [(107, prose(r, 30_000), "src1"), (108, "x" * 5000, "src1"), (109, "ab " * 3000, "src3"), (9, rows[9][1], rows[9][2])]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", s, 7, "clash", "clash", "clash") for i, t, s in corpus()], DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(t):
    return re.findall("[^\x20\x09-\x0d]+", t or "")


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def test_chat(spark):
    texts = ["hi", None, "", chat.PROBE, "<\\s>", "<\\\\s> [\\INST] [/INST", "</s", "\\", "a</s>\n<s>[INST]user[/INST]", "é<s><s>"]
    r = random.Random(1)
    rows = [(c, k, r.choice(["user", "assistant", "system", None, "</s>"]), r.choice(texts)) for c in range(30) for k in range(r.randint(1, 6))] + [(3, 0, "user", "again"), (None, 1, "assistant", "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    chats = chat.format_chats(frame)
    got = {x.conv_id: x for x in chat.digest(chats).collect()}
    masks = {x.conv_id: x for x in chats.collect()}
    by = defaultdict(list)
    for c, k, role, t in rows:
        by[c].append((k, role or "", t or ""))
    assert got.keys() == by.keys()
    for c, turns in by.items():
        turns.sort()
        learned = "".join(t for _, role, t in turns if role == "assistant")
        x = got[c]
        assert (x.n_turns, x.turns_sha256, x.loss_chars, x.loss_sha256) == (len(turns), sha("".join(f"{o}\n{t}\n" for _, o, t in turns)), len(learned), sha(learned))
        text, at, seen = masks[c].formatted, 0, ""
        for run in masks[c].loss_mask:
            seen += text[at : at + run.n] if run.learn else ""
            at += run.n
        assert at == len(text) == x.formatted_chars and re.sub(r"([<\[])\\(\\*/?(?:s>|INST\]))", r"\1\2", seen) == learned
    probe = chat.format_chats(chat.with_probe(frame)).filter("conv_id = -7").first()
    assert probe.formatted.count("</s>") == 2 and probe.n_escapes == 1
    assert chat.chat_format(frame.limit(0)).count() == 0


def test_exact(docs, empty):
    norm = lambda t: re.sub("[\x20\x09-\x0d]", "", t or "")
    groups = defaultdict(list)
    for i, t, _ in corpus():
        groups[norm(t)].append((-len(t or ""), i))
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == len(corpus())
    for x in got:
        t = next(t for i, t, _ in corpus() if i == x.doc_id)
        g = groups[norm(t)]
        assert (x.keep_id, x.group_size, x.kept, x.text_sha256) == (min(g)[1], len(g), min(g)[1] == x.doc_id, sha(norm(t)))
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_exact_rounds(spark):
    """Every round leaves a quarter of the runs, each sorted by digest within a slot, the best row of each digest, and all counts."""
    r = random.Random(3)
    frame = spark.createDataFrame([(i, r.choice(WORDS) + " " * r.randint(0, 3)) for i in range(800)], "doc_id long, text string").repartition(16)
    members = exact_dedup.digests(frame)
    rounds = exact_dedup.rounds_for(16)
    runs = exact_dedup.first_runs(members, rounds)
    assert rounds == 2 and runs.select("run").distinct().count() == 16
    for k in range(1, rounds + 1):
        runs = exact_dedup.merge_round(runs, k, rounds)
        got = runs.withColumn("part", F.spark_partition_id()).collect()
        assert {x.run for x in got} == set(range(16 // 4**k)) and sum(x.group_size for x in got) == 800
        assert len({(x.run, bytes(x.digest)) for x in got}) == len(got)
        for part in {x.part for x in got}:
            own = [(x.run, bytes(x.digest)) for x in got if x.part == part]
            assert own == sorted(own)
            if k == rounds:  # one range of digests to a task
                assert len({x[1][0] * 16 >> 8 for x in own}) == 1
    assert len(got) == len(WORDS)


def test_lines(spark, docs, empty):
    got = {x.doc_id: x for x in line_dedup.line_dedup(docs).collect()}
    texts = {i: t for i, t, _ in corpus()}
    assert got[90].n_dropped == 0 and got[90].text == texts[90]
    assert all(got[i].n_dropped == 1 and "rights" not in got[i].text and got[i].text.count("\n") == 1 for i in range(91, 100))
    assert all(got[i].text == texts[i] for i in (1, 60 - 1, 100, 101, 102, 107, 108)) and got[100].n_lines == 0
    assert line_dedup.line_dedup(empty).columns[:8] == empty.columns
    varied = [f"User number one named {n} has logged in from the main office today at noon" for n in ("anna", "boris", "carla", "dmitri")]
    four = spark.createDataFrame([(i, v) for i, v in enumerate(varied)], "doc_id long, text string")
    assert sorted((x.doc_id, x.text == "") for x in line_dedup.line_dedup(four).collect()) == [(0, False), (1, True), (2, True), (3, True)]


def brute_suffix(rows, width=100):
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda x: (x[0], x[1] or "")):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - width + 1):
            if b[s : s + width] in seen:
                gone[s : s + width] = b"\1" * width
            seen.add(b[s : s + width])
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[d] = (len(b), sum(gone), sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1])), sha(kept))
    return out


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 4])
def test_suffixes(spark, empty, hot):
    r = random.Random(2)
    base = ["".join(r.choice("abc ") for _ in range(r.randint(50, 700))) for _ in range(12)]
    rows = [(i, "".join(r.choice(base)[r.randint(0, 200) :][: r.randint(50, 400)] + r.choice(["", "x", "é"]) for _ in range(r.randint(0, 5)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "a" * 3000), (503, "ab" * 2000), (504, "a" * 99), (505, rows[3][1]), (506, "".join(r.choice("abcdefgh") for _ in range(1_200_000)))]
    rows.append((507, rows[-1][1][600_000:] + "zz" + rows[-1][1][:1000]))
    frame = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, tie int").repartition(4)
    got = {x.doc_id: tuple(x)[1:] for x in suffix_dedup.digest(suffix_dedup.suffix_dedup(frame, hot=hot)).collect()}
    assert got == brute_suffix(rows)
    assert suffix_dedup.suffix_dedup(empty).count() == 0


def test_loser_tree():
    r = random.Random(3)
    runs = [sorted("".join(r.choice("ab") for _ in range(r.randint(0, 9))).encode() for _ in range(r.randint(0, 40))) for _ in range(7)]
    out = list(suffix_dedup.LoserTree([suffix_dedup.front_code([(k, i) for k in run]) for i, run in enumerate(runs)]))
    assert [k for _, k, _ in out] == sorted(itertools.chain(*runs))
    assert all(s == suffix_dedup.common_prefix(a, b, 0) for (_, a, _), (s, b, _) in itertools.pairwise(out))


@pytest.mark.parametrize("seed", range(6))
def test_repeats_by_common_prefixes(seed):
    """Contexts of one anchor, a few and many: pairs and blocks of common prefixes agree with a set of windows."""
    r = random.Random(seed)
    width, gram = 20, b"GRAM"
    side = ["".join(r.choice("ab") for _ in range(16)).encode() for _ in range(4)]
    vary = lambda b: b if r.random() < 0.5 else b[: (k := r.randrange(16))] + r.choice([b"c", b"d"]) + b[k + 1 :]
    rows = []
    for d in range([2, 8, 12, 13, 60, 200][seed]):
        left, right = vary(r.choice(side))[r.randint(0, 16) :], gram + vary(r.choice(side))[: r.randint(0, 16)]
        if len(left) + len(right) >= width:
            rows.append((suffix_dedup.context_key(7, right, left), (d, 0, 50), left, right))
    tree = suffix_dedup.LoserTree([suffix_dedup.unpacked(suffix_dedup.packed([(s, k, p) for s, k, p in suffix_dedup.front_code([x[:2] for x in sorted(rows[i::3])])])) for i in range(3)])
    got = defaultdict(set)
    for d, _, s, e in suffix_dedup.repeats(tree, width):
        got[d] |= set(range(s, e))
    want, seen = defaultdict(set), set()
    for _, (d, _, at), left, right in sorted(rows, key=lambda x: x[1]):
        for j in range(len(left) + 1):
            window = (left[len(left) - j :] + right)[:width]
            if len(window) == width:
                if (j, window) in seen:
                    want[d] |= set(range(at - j, at - j + width))
                seen.add((j, window))
    assert got == want


def test_classifier(spark, empty):
    r = random.Random(6)
    good = [(i, " ".join(prose(r, 12).capitalize() + "." for _ in range(r.randint(4, 20)))) for i in range(150)]
    bad = [(200 + i, " ".join(w + r.choice(["***", "$$$"]) for w in prose(r, 60).split())) for i in range(15)] + [(220 + i, " ".join(w + "!!" for w in prose(r, 60).upper().split())) for i in range(15)] + [(240 + i, " ".join([r.choice(WORDS)] * 80)) for i in range(15)]
    frame = spark.createDataFrame([(i, t, 0) for i, t in good + bad] + [(300, None, 0), (301, "", 0), (None, good[0][1], 0), (1, good[1][1], 0), (1, good[2][1], 0)], "doc_id long, text string, votes int")
    rows = quality_classifier.classify(frame).collect()
    got = {x.doc_id: x for x in rows}
    assert len(rows) == len(good) + len(bad) + 5 and len(got) == len(good) + len(bad) + 3
    assert sorted(map(str, rows)) == sorted(map(str, quality_classifier.classify(frame.repartition(7), sample=2000).collect()))
    right = [got[i].kept for i, _ in good] + [not got[i].kept for i, _ in bad]
    assert all(got[i].kept for i, _ in good) and sum(right) / len(right) > 0.97
    assert quality_classifier.classify(empty).count() == 0


def test_estimate():
    """EM finds the rates of planted labelers that overlap, none of which it is told."""
    r = random.Random(21)
    rates = [(0.6, 0.02), (0.7, 0.05), (0.4, 0.01), (0.8, 0.1), (0.3, 0.03), (0.5, 0.002)]
    counts = Counter()
    for _ in range(40_000):
        good = r.random() < 0.85
        counts[sum(1 << k for k, (hit, alarm) in enumerate(rates) if r.random() < (alarm if good else hit))] += 1
    share, got, posterior = quality_classifier.estimate(sorted(counts.items()), n=6)
    assert abs(share - 0.85) < 0.02 and all(abs(g - w) < 0.05 for x, y in zip(got, rates, strict=True) for g, w in zip(x, y, strict=True))
    assert posterior[0] > 0.95 and posterior[0b1011] < 0.05


def base_spans(t):
    out = []
    for k, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
            if {"email": True, "ip": k == "ip" and all(int(x) < 256 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[k]:
                out.append(f"{k}:{m.start()}:{m.end()}")
    return out


def test_pii(spark, empty):
    r = random.Random(7)
    texts = [None, "", "a@b.c@d.e x_a@b.c_x@d.e.f", "1.2.3.4.5.6.7.8 300.1.1.1 0001.002.3.255", "4041894974608795 4041-8949 7460-8795 1", "+1 (988) 555-2485 ++12 34567890 +1((((", "é+49 30 123456789 é a@b.co", "a" * 3000 + "@x.y", "1" * 3000, "a.b." * 2000 + "@c." + "d." * 3000 + "e", "+1" * 500]
    texts += ["".join(r.choice("ab1240.@+-() 9_é") for _ in range(r.randint(5, 60))) for _ in range(400)]
    texts += [f"note password={r.getrandbits(70):018x} and key AKIA{r.getrandbits(60):016X} in chapter {r.randint(1, 99)}" for _ in range(60)]
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, email string")
    got = {x.doc_id: x for x in pii.digest(pii.find_pii(frame)).collect()}
    for i, t in enumerate(texts):
        want = base_spans(t or "")
        assert got[i].base_sha256 == sha(",".join(want)) and got[i].spans.split(",")[: len(want)] == (want or got[i].spans.split(",")[:0])
    secret = texts[-1]
    assert f"private:{secret.index('password=') + 9}:{secret.index(' and')}" in got[len(texts) - 1].spans  # what the key word announces, without it
    assert pii.digest(pii.find_pii(empty)).count() == 0


def test_pii_added_spans(spark):
    """The added spans against brute force: candidates, votes and features by another regex engine, the same estimate."""
    import regex

    r = random.Random(11)
    parts = ["note", "the", "Anna Weber", "(Maria", "Peter,", "Mr. Paul Klein", "token = ", "password is hunter", "12 Baker Street", "page 14", '"a1b2c3d4e5f6a7b8c9"', "AKIA1234567890ABCD", "a@b.co", "1.2.3.4", "+1 988 555 2485", "user: bob", "x=9", "###", "!!", "7", "2021-03-04", "é9"]
    texts = [" ".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(150)]
    rows = []
    for i, t in enumerate(texts):
        base = [tuple(map(int, x.split(":")[1:])) for x in base_spans(t)]
        last = 0
        hits = [(m.start(), m.end()) for m in regex.finditer(pii._TOKEN, t)]
        for k, (s, e) in enumerate(hits):
            gap, after = t[last:s], t[e : hits[k + 1][0] if k + 1 < len(hits) else len(t)]
            bare = regex.sub(pii._LEAD, "", t[s:e])
            start = e - len(bare)
            tok = regex.sub(pii._TAIL, "", bare)
            if regex.search(r"[\p{L}0-9]", tok) and not any(a < start + len(tok) and start < b for a, b in base):
                x = {"tok": tok, "before": (gap + t[s:start])[-pii.CONTEXT :], "after": after[: pii.CONTEXT]}
                votes = sum(3**n * (1 if regex.search(yes, x[f]) else 2 if regex.search(no, x[f]) else 0) for n, (_, f, yes, no) in enumerate(pii.LABELERS))
                bits = sum(1 << n for n, (f, p) in enumerate(pii.FEATURES) if regex.search(p, x[f]))
                rows.append((i, start, start + len(tok), votes, bits))
            last = e
    _, _, posterior = pii.estimate(sorted(Counter(x[3] for x in rows).items()))
    shares = defaultdict(list)
    for x in rows:
        shares[x[4]].append(posterior[x[3]])
    weights = pii.train([(b, sum(ps) / len(ps), len(ps)) for b, ps in sorted(shares.items())])
    want = defaultdict(list)
    for i, s, e, _, bits in rows:
        if weights[-1] + sum(w for n, w in enumerate(weights[:-1]) if bits >> n & 1) > 0:
            want[i].append(f"private:{s}:{e}")
    got = pii.digest(pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()
    assert {x.doc_id: [s for s in x.spans.split(",") if s.startswith("private")] for x in got} == {i: want[i] for i in range(len(texts))}
    assert sum(map(len, want.values())) > 50 and all(x.n_spans == len([s for s in x.spans.split(",") if s]) for x in got)


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.tokenizer_file())
    rows = packing.pack(docs, capacity=1024).collect()
    want = Counter()
    for i, t, _ in corpus():
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        want.update((i, k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())) for k, (a, b) in enumerate(itertools.pairwise(cuts)))
    assert Counter(tuple(x)[:5] for x in rows) == want
    by = defaultdict(list)
    for x in rows:
        by[x.sequence_id].append((x.offset, x.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(empty).count() == 0


def test_encoder():
    from tokenizers import Tokenizer

    whole, own, r = Tokenizer.from_file(packing.tokenizer_file()), packing.Encoder(packing.tokenizer_file()), random.Random(1)
    texts = ["", " ", "  a", "a  b", "a \nb", "it's don't", "a<|endoftext|>b", "日本 語", "x  y", "a 's b"] + ["".join(r.choice("ab '\n\t1.é!s\x85 ") for _ in range(r.randint(1, 30))) for _ in range(3000)]
    assert all(own(t) == np.array(whole.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts)


def test_configurations():
    """An optimal fractional packing: the known optimum of a small instance, and no more than demanded."""
    got = packing.configurations([60, 40, 30], [100, 100, 100], 100)
    made = Counter()
    for uses, n in got:
        assert sum([60, 40, 30][g] * k for g, k in uses.items()) <= 100
        for g, k in uses.items():
            made[g] += k * n
    # 100 of 60 + 40, and 100 pieces of 30 by threes
    assert 131 <= sum(n for _, n in got) <= 134 and all(made[g] <= 100 for g in range(3)) and made[0] == made[1] == 100


@pytest.mark.parametrize("seed", range(4))
def test_plan(seed):
    r = random.Random(seed)
    counts = {r.randint(1, 1024): r.randint(1, 3000) for _ in range([1, 5, 300, 900][seed])}
    plan = packing.Plan(counts)
    least = -(-sum(n * c for n, c in counts.items()) // 1024)
    assert dict(plan.used) == counts
    length = np.repeat(list(counts), list(counts.values()))
    seq, at = plan.places(length, np.concatenate([np.arange(c) for c in counts.values()]))
    order = np.lexsort((at, seq))
    seq, at, length = seq[order], at[order], length[order]
    new = np.append(True, seq[1:] != seq[:-1])
    assert (at[new] == 0).all() and (at[~new] == (at + length)[:-1][~new[1:]]).all() and (at + length).max() <= 1024
    # pieces above half a sequence meet no other such piece; what is small beside them only fills their room
    large = lambda k: [(n, c) for n, c in counts.items() if n > 512 and n <= 1024 - k]
    rest = lambda k: sum(n * c for n, c in counts.items() if k <= n <= 512) - sum((1024 - n) * c for n, c in large(k))
    least = max(least, *(sum(c for n, c in counts.items() if n > 512) + max(0, -(-rest(k) // 1024)) for k in range(1, 513)))
    assert least <= plan.sequences <= 1.03 * least


def near_truth(rows, k=4):
    sets = {}
    for i, t, *_ in rows:
        w = words((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w)} if 0 < len(w) < k else {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((top(a), top(b)))
            up[y] = x
    return {i: (len(s), top(i), top(i) == i) for i, s in sets.items()}


def test_near(docs, empty):
    got = near_dedup.near_dedup(docs).collect()
    assert len(got) == len(corpus())
    truth = near_truth(corpus())
    assert {x.doc_id: tuple(x)[1:] for x in got} == truth
    assert near_dedup.near_dedup(empty).count() == 0


@pytest.mark.parametrize("heavy", [near_dedup.HEAVY, 3])
def test_near_strays(spark, heavy):
    """A loose family: copies of copies, many of them unlike the hub; also with buckets cut into parts."""
    r = random.Random(9)
    texts = [" ".join(f"w{r.randrange(5000)}" for _ in range(60))]
    while len(texts) < 90:
        w = r.choice(texts[-12:]).split()
        for _ in range(r.randint(1, 3)):
            w[r.randrange(len(w))] = f"w{r.randrange(5000)}"
        texts.append(" ".join(w))
    rows = [(i, t) for i, t in enumerate(texts)]
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), heavy=heavy).collect()
    assert {x.doc_id: tuple(x)[1:] for x in got} == near_truth(rows)


def test_components(spark):
    """Paths, stars and random graphs against union-find."""
    r = random.Random(8)
    links = [(i, i + 1) for i in range(100, 140)] + [(200, 200 + i) for i in range(1, 30)] + [(400 + r.randrange(80), 400 + r.randrange(80)) for _ in range(60)] + [(700 + (i * 7) % 31, 700 + ((i + 1) * 7) % 31) for i in range(31)]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        if a != b:
            x, y = sorted((top(a), top(b)))
            up[y] = x
    got = {x.node: x.component for x in near_dedup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: top(x) for x in up}


def test_shingles_of_long_texts():
    r = random.Random(2)
    text = (" ".join(r.choice(WORDS) for _ in range(600_000))).encode()
    long, _ = bytescan.batch_word_hashes([text])
    assert len(long) == 600_000 and len(np.unique(long)) == len(set(text.split()))


def test_rules(docs, empty):
    got = defaultdict(list)
    for x in quality_rules.quality_rules(docs).collect():
        got[x.doc_id].append(x)
    for i, t, _ in corpus():
        w, lines = words(t), [x for x in (t or "").split("\n") if words(x)]
        wins = Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        at = {q for j in range(len(w) - 2) if wins[tuple(w[j : j + 3])] > 1 for q in (j, j + 1, j + 2)}
        for x in got[i]:
            assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(at))
            assert x.base_failed == (len(w) < 50 or 100 * len(at) > 50 * len(w)) and x.kept == (x.failed_bits == 0)
    book = quality_rules.ledger(docs)
    policy = quality_rules.POLICIES[-1]
    by = {x.rule: x for x in quality_rules.ablations(book, policy).collect()}
    assert by["few_words"].n_failed == book.filter("n_words < 50").count() and by["few_words"].n_failed_alone == book.filter("failed_bits = 1").count()
    assert quality_rules.kept_rows(docs).columns == docs.columns and quality_rules.quality_rules(empty).count() == 0


def water(sizes, weights, cap=3):
    """Targets by rounds: who is above the cap stops there, the excess is shared anew."""
    total, open_, out = sum(sizes.values()), dict(weights), {}
    left = total
    while open_:
        share = {s: left * w / sum(open_.values()) for s, w in open_.items()}
        over = [s for s in share if share[s] > cap * sizes[s] + 1e-9]
        if not over:
            return out | share
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
            del open_[s]
    return out


@pytest.mark.parametrize("cut", [True, False])
def test_mixing(docs, empty, cut):
    rows = mixing.mix(docs, cut=cut).collect()
    assert len(rows) == len(corpus()) and sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(docs.repartition(5), cut=cut).collect()))
    sizes, source = Counter(), {}
    for i, t, s in corpus():
        sizes[s] += len(words(t))
        source[i] = s
    order = sorted((s for s in sizes if s is not None)) + [None]
    want = water(sizes, {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)})
    taken, biggest = Counter(), Counter()
    for x in rows:
        s = source[x.doc_id]
        assert x.source_size == sizes[s] and abs(x.target - want[s]) < 1e-6 * max(1, want[s]) and 0 <= x.taken <= 3 * x.size
        assert cut or x.taken % max(1, x.size) == 0
        taken[s] += x.taken
        biggest[s] = max(biggest[s], x.size)
    assert all(abs(taken[s] - want[s]) <= (2 if cut else biggest[s]) for s in sizes)
    assert mixing.mix(empty).count() == 0


def test_pipeline(spark, docs, empty, tmp_path):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "minhash_near_dedup", "mixing", "best_fit_packing"]
    for source in (docs, empty):
        at = source
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, at, "")
            out.write.mode("overwrite").parquet(str(tmp_path / name))
            before, at = at, spark.read.parquet(str(tmp_path / name))
            assert k == 4 or at.columns == docs.columns
            if source is docs and name == "quality_rules":
                keep = quality_rules.quality_rules(before).filter("kept")
                assert sorted(x.doc_id for x in at.collect()) == sorted(x.doc_id for x in keep.collect())
            if source is docs and name == "minhash_near_dedup":
                truth = near_truth([(x.doc_id, x.text) for x in before.collect()], 5)
                assert sorted(x.doc_id for x in at.collect()) == sorted(i for i, x in truth.items() if x[2])
            if source is docs and name == "mixing":
                assert {x.text for x in at.collect()} <= {x.text for x in before.collect()}
        assert "sequence_id" in at.columns and (source is empty) == at.isEmpty()


@pytest.mark.parametrize("k", [4, 5])
def test_shingles_of_few_words(k):
    """A batch of one text of 1 to k words has one shingle, the same as beside other texts."""
    for n in range(1, k + 1):
        few, more = " ".join(WORDS[:n]).encode(), " ".join(WORDS).encode()
        alone, first = bytescan.shingles(*bytescan.batch_word_hashes([few]), k)
        beside, _ = bytescan.shingles(*bytescan.batch_word_hashes([few, more]), k)
        assert first.tolist() == [0, 1] and alone.tolist() == beside[:1].tolist()


def test_near_stage_rows(spark):
    """Null ids stay whatever other ids do; texts that share an id stay unless they are copies."""
    from breachline.llm.pipeline_stages import near_stage

    r = random.Random(12)
    a, b, c, d, e = (prose(r, 40) for _ in range(5))
    rows = [(1, a), (1, b), (1, a), (2, b), (3, e), (None, c), (None, d), (4, None), (4, e)]
    got = near_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(x.text or "" for x in got) == sorted([a, b, c, d, e, ""])
    assert sorted(x.text for x in got if x.doc_id is None) == sorted([c, d])


def test_lines_of_two_documents(spark):
    """Two documents are enough for words as they are, and one word is enough for a line."""
    long = " ".join(WORDS)
    rows = [(1, f"{long}\nShare\nonly here"), (2, f"{long}\nhere too"), (3, "Share\n \nand there"), (4, "2021"), (5, "2022"), (6, "2023")]
    got = {x.doc_id: x.text for x in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "here too", 3: " \nand there", 4: "2021", 5: "2022", 6: "2023"}


def test_line_fields(spark):
    """Words vary in short lines, at the start, and in several places at once; long lines with words of their own stay."""
    r = random.Random(3)
    names = [f"name{c}" for c in "abcdefgh"]
    days = ["Monday", "Tuesday", "Friday"]
    long = [prose(r, 300) for _ in range(3)]
    own = [" ".join(f"{c}{'xyz'[i]}" for c in WORDS) for i in range(3)]
    rows = [(i, f"Posted by {v} on {days[i % 3]}\n{v} was here\n{v} has logged in from the main office in {v[::-1]} and left at noon for lunch") for i, v in enumerate(names)]
    rows += [(20 + i, f"{long[0]} {own[i]}") for i in range(3)]
    got = {x.doc_id: (x.n_dropped, x.text) for x in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == (0, rows[0][1]) and all(got[i] == (3, "") for i in range(1, 8))
    assert all(got[20 + i] == (0, rows[8 + i][1]) for i in range(3))


def brute_lines(rows, min_docs=3):
    """Places of dropped lines per (id, text), by strings instead of hashes."""
    lines, exact, whole, leaves = {}, defaultdict(set), defaultdict(set), defaultdict(list)
    for i, t in {(i, t) for i, t in rows if i is not None and t is not None}:
        for k, line in enumerate(t.split("\n")):
            w = tuple(words(line))
            if w:
                m = tuple("<*>" if re.search("[0-9]", x) else x for x in w)
                lines[i, t, k] = w, m
                exact[w].add(i)
                whole[m].add(i)
    lost = {at for at, (w, m) in lines.items() if (len(exact[w]) > 1 and min(exact[w]) < at[0]) or (len(w) > 2 and len(whole[m]) >= min_docs and min(whole[m]) < at[0])}
    for at, (w, m) in lines.items():
        if at not in lost and len(w) > 2:
            blocks = min(len(w), 5)
            for b in range(blocks):
                leaves[len(w), b, m[len(w) * b // blocks : len(w) * (b + 1) // blocks]].append((at, w, m))
    held, first = defaultdict(set), {}
    templates = defaultdict(set)
    for own in leaves.values():
        often = Counter((p, x) for _, _, m in own for p, x in enumerate(m))
        for at, w, m in own:
            order = sorted(range(len(m)), key=lambda p: (often[p, m[p]], p))
            for v in range(1, min(4, max(1, int(len(m) * 0.4))) + 1):
                key = len(m), frozenset((p, m[p]) for p in order[v:])
                templates[at].add(key)
                held[key] |= exact[w]
                first[key] = min(first.get(key, at[0]), at[0])
    lost |= {at for at, keys in templates.items() if any(len(held[k]) >= min_docs and first[k] < at[0] for k in keys)}
    out = defaultdict(set)
    for i, t, k in lost:
        out[i, t].add(k)
    return out


@pytest.mark.parametrize("cells", [line_dedup.CELLS, 40])
def test_lines_brute(spark, monkeypatch, cells):
    """Against brute force: repeated and null ids, equal rows, fields anywhere, clashing names; large leaves by aggregates."""
    monkeypatch.setattr(line_dedup, "CELLS", cells)
    r = random.Random(5)
    frames = [prose(r, n).split() for n in (1, 2, 3, 3, 4, 5, 6, 9, 12, 20)]
    rows = []
    for i in range(90):
        lines = []
        for _ in range(r.randint(1, 5)):
            w = list(r.choice(frames))
            for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
                w[r.randrange(len(w))] = r.choice(["anna", "boris", "c7", "9", *WORDS])
            lines.append(r.choice(["", " "]) + " ".join(w))
        rows.append((r.choice([i, i % 40, None]), "\n".join(lines)))
    rows += [rows[3], rows[4], rows[4], (7, None), (8, ""), (9, "\n \n"), (1000, " ".join(frames[9] * 3000))]
    want = brute_lines(rows)
    frame = spark.createDataFrame([(*x, 1, 2, 3, 4) for x in rows], "doc_id long, text string, lost int, hash int, row int, n_dropped int").repartition(3)
    got = line_dedup.line_dedup(frame).collect()
    cut = Counter()
    for i, t in rows:
        gone = want.get((i, t), set())
        kept = [x for k, x in enumerate((t or "").split("\n")) if k not in gone]
        text = t if not gone else "\n".join(kept) if any(map(words, kept)) else ""
        cut[i, text, 0 if t is None else t.count("\n") + 1, len(gone)] += 1
    assert Counter((x.doc_id, x.text, x.n_lines, x.n_dropped) for x in got) == cut
    assert got[0].asDict().keys() == {"doc_id", "text", "lost", "hash", "row", "n_lines", "n_dropped"} and sum(map(len, want.values())) > 50


def test_pipeline_rows(spark, tmp_path):
    """Repeated and null ids, equal rows, nulls in all columns, clashing names: rows go through all stages as rows."""
    import corpus_pipeline

    r = random.Random(31)
    long = lambda n: " ".join(f"{r.choice(WORDS)}{r.choice('abcdefgh')}" for _ in range(n))
    texts = [long(r.randint(60, 150)) + "." for _ in range(24)]
    names = ["row", "id", "key", "hash", "n", "least", "copy", "i", "h", "s", "ti", "copies", "lost", "line", "n_lines", "n_dropped", "failed_bits", "held", "part", "length"]
    schema = "doc_id long, text string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in names)
    rows = [(i if i % 3 else None, t, r.choice(["a", "b", None]), len(t)) for i, t in enumerate(texts)]
    rows += [(7, texts[3], "a", 1), (7, long(80), "a", None), (7, long(90), None, 3), rows[5], rows[5], (None, None, None, None), (50, None, "b", None), (51, "", "b", 0)]
    frame = spark.createDataFrame([(*x, *[f"{c}{k}" if k % 2 else None for c in names]) for k, x in enumerate(rows)], schema).repartition(3)
    at, kept = frame, {}
    for name, stage in corpus_pipeline.STAGES:
        again = Counter(map(str, stage(spark, at.repartition(5), "").collect()))
        stage(spark, at, "").write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        kept[name] = at.collect()
        assert name == "best_fit_packing" or (at.columns == frame.columns and again == Counter(map(str, kept[name])))
    count = lambda name: Counter((x.doc_id, x.text) for x in kept[name])
    assert sum(count("quality_rules").values()) == len(rows) - 3 and count("line_dedup").keys() <= count("quality_rules").keys()
    near = count("minhash_near_dedup")
    assert sum(n for (i, _), n in near.items() if i is None) == 8 and max(near.values()) == 1 and sum(n for (i, _), n in near.items() if i == 7) >= 3
    # every row that the mix takes is there as often as its own decision says
    made = Counter()
    for x in mixing.decisions(spark.read.parquet(str(tmp_path / "minhash_near_dedup")), cut=False).collect():
        made[x.doc_id, x.text_hash] += int(x.copies)
    got = Counter((x.doc_id, x.hash_) for x in spark.read.parquet(str(tmp_path / "mixing")).select("doc_id", F.xxhash64("text").alias("hash_")).collect())
    assert got == +made
    pieces = Counter(x.doc_id for x in kept["best_fit_packing"] if x.piece == 0)
    assert sum(pieces.values()) == sum(count("mixing").values())
