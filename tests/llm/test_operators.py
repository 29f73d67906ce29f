import base64
import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict
from functools import lru_cache

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from cairn.llm import bpe, lines, packing, pii, quality, queries, search, sharding, similar, simhash, suffixes, wordpiece
from cairn.session import scratch

from .conftest import CLASH, ODD, SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.select(*cols).collect()), key=str)


def against_sql(spark, folder, docs, name):
    """The rows of a registered query over ``docs`` as its table, held against its SQL."""
    docs.write.parquet(f"{folder}/documents.parquet")
    got = queries.QUERIES[name](spark, str(folder))
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
        want = con.execute(queries.ORACLE[name])
        columns = [c[0] for c in want.description]
        assert sorted(columns) == sorted(got.columns)
        assert rows(got, *columns) == sorted(want.fetchall(), key=str)
    return got.collect()


# ---- quality rules


def brute_quality(text):
    w = WORD.findall(text)
    grams = list(zip(*[w[i:] for i in range(5)], strict=False))
    count = Counter(grams)
    covered = {i + j for i, g in enumerate(grams) if count[g] > 1 for j in range(5)}
    own = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(own) - len(set(own)), len(covered)


def test_quality_against_brute_force(docs, texts):
    got = {r.doc_id: tuple(r[n] for n, _ in quality.MEASURES) for r in quality.ledger(docs).collect()}
    assert got == {k: brute_quality(t) for k, t in texts.items()}


def test_quality_sorted_windows():
    rng = random.Random(3)
    for n in (*range(12), 60, 200):
        words = [rng.choice([b"a", b"b", b"c"]) for _ in range(n)]
        want = brute_quality(b" ".join(words).decode())[4]
        assert quality.repeat_words(words) == want
        if n >= quality.WINDOW + 1:
            assert quality._repeat_words_sorted(words) == want


def test_quality_ablation(docs):
    ledger = quality.ledger(docs)
    bits = [r.failed_bits & quality.POLICIES["web-v2"] for r in ledger.collect()]
    for r in quality.ablation(ledger).collect():
        b = quality.BIT[r.rule]
        assert (r.n_failed, r.n_failed_alone, r.n_kept_without) == (sum(x & b > 0 for x in bits), bits.count(b), sum(x & ~b == 0 for x in bits))


def test_quality_query_against_its_sql(spark, tmp_path, docs):
    odd_texts = spark.createDataFrame([(r[0], r[1]) for r in ODD if r[0] != 5], "doc_id long, text string")
    got = against_sql(spark, tmp_path, docs.select("doc_id", "text").unionByName(odd_texts.where("doc_id IS NOT NULL").withColumn("doc_id", F.col("doc_id") + 10_000)), "op6_quality_rules")
    sole = Counter(r.sole_failure for r in got)
    for r in quality.ablation(quality.ledger(docs)).collect():
        assert sole[quality.BIT[r.rule]] >= r.n_failed_alone
    assert sole[0] >= sum(r.kept for r in got)


def test_quality_odd(odd, none):
    assert rows(quality.ledger(odd), "n_words", "word_chars", "n_repeat_words") == sorted((tuple(brute_quality(r[1] or "")[i] for i in (0, 1, 4)) for r in ODD), key=str)
    kept = quality.filter_documents(odd)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} == {7, 8, 10}
    assert quality.filter_documents(none).count() == 0


# ---- fingerprints


def brute_fingerprint(text):
    text = text.translate({c: c + 32 for c in range(65, 91)})
    w = WORD.findall(text)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    """fps: id -> fingerprint; the least id reachable."""
    root = {k: k for k in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(fps, 2):
        if (fps[a] ^ fps[b]).bit_count() <= 3:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {k: find(k) for k in fps}


def test_simhash_query_against_brute_force(spark, texts):
    fps = {k: brute_fingerprint(t) for k, t in texts.items()}
    group = brute_components(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.QUERIES["op3_simhash"](spark, SF).collect()}
    assert got == {k: (f"{fps[k]:016x}", group[k]) for k in texts}


def test_links_join_dense_and_chained_fingerprints(spark):
    rng = random.Random(5)
    fps = {0, (1 << 64) - 1}
    for _ in range(40):  # chains and clusters around random centres
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 3, 12])):
            fps.add(x)
            for b in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << b
    fps = {i: x for i, x in enumerate(sorted(fps))}
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps.values()], "fp long")
    from cairn.llm.graph import components

    pairs = simhash.links(df).collect()
    signed = {(x - (1 << 64) if x >> 63 else x): i for i, x in fps.items()}
    assert all((fps[signed[a]] ^ fps[signed[b]]).bit_count() <= 3 for a, b in pairs)
    group = brute_components(fps)
    want = defaultdict(set)
    for i, r in group.items():
        want[r].add(i)
    got = defaultdict(set)
    for node, root in components(simhash.links(df)).collect():
        got[root].add(signed[node])
    assert sorted(map(sorted, got.values())) == sorted(sorted(s) for s in want.values() if len(s) > 1)


def test_components_of_a_long_chain(spark):
    from cairn.llm.graph import components

    df = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert set(components(df).collect()) == {(i, 0) for i in range(201)}
    assert components(df.limit(0)).count() == 0


def test_simhash_odd(odd, none):
    got = rows(simhash.near_duplicates(odd), "doc_id", "component_id")
    want = [(1, 1), (2, 1), (3, 1), (5, 5), (5, 5), (7, 7), (8, 7), (9, 9), (10, 10), (None, None)]
    assert got == sorted(want, key=str)
    kept = simhash.deduplicate(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 5, 7, 9, 10, None], key=str)
    assert simhash.near_duplicates(none).count() == 0


def brute_similar(table):
    """table: id -> text; the least id reachable over pairs of Jaccard similarity 0.8 or more of five-word shingles."""
    sets = {}
    for k, t in table.items():
        w = WORD.findall(t.translate({c: c + 32 for c in range(65, 91)}))
        sets[k] = {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or {" ".join(w)} - {""}
    root = {k: k for k in table}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if sets[a] == sets[b] or 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {k: find(k) for k in table}


def test_deduplicate_against_brute_jaccard(spark, docs, texts):
    want = brute_similar(texts)
    assert {r.doc_id: r.component_id for r in similar.near_duplicates(docs).collect()} == want
    assert {r.doc_id for r in simhash.deduplicate(docs).collect()} == set(want.values())
    assert want[177] == 1 and want[145] == 6  # 11 and 7 bits apart


def test_similar_on_tangled_edits(spark):
    """Groups around a base, chains, pairs just at and just under the threshold, and a passage that all share."""
    rng = random.Random(19)
    made = ["", " ", "a b c", "A  b c", "a b c d", *(" ".join(f"e{i}" for i in range(n)) for n in (8, 9, 12, 13, 14, 49, 59))]
    passage = [f"p{i}" for i in range(30)]
    for g in range(12):
        words = [f"g{g}w{rng.randrange(400)}" for _ in range(rng.choice([20, 60, 150]))] + passage * (g % 2)
        for _ in range(rng.choice([2, 9, 25])):
            made.append(" ".join(words))
            edited = [*words]
            for _ in range(rng.choice([1, 1, 2, 4])):
                edited[rng.randrange(len(edited))] = f"x{rng.randrange(10**6)}"
            made.append(" ".join(edited))
            if g % 3 == 0:
                words = edited
    table = dict(enumerate(made))
    df = spark.createDataFrame([*table.items()], "doc_id long, text string").repartition(3)
    want = brute_similar(table)
    assert 20 < len(set(want.values())) < len(made) - 50
    assert {r.doc_id: r.component_id for r in similar.near_duplicates(df).collect()} == want


def test_near_dedup_checks_what_fingerprints_link(spark, monkeypatch):
    """Without rare shingles the stage finds the similar texts within 3 bits and no others; unlike texts within 3 bits stay; with them all are found."""
    import corpus_pipeline

    words = [f"w{i}" for i in range(2_000)]
    table = {0: " ".join(words), 1: " ".join([*words[:1_000], "x", *words[1_001:]])}
    table |= {2 + i: "ha " * 3_000 + " ".join(f"{c}{j}" for j in range(30)) for i, c in enumerate("ab")}
    table |= {4: " ".join(f"v{i}" for i in range(60)), 5: " ".join([*(f"v{i}" for i in range(60)), *(f"z{i}" for i in range(8))])}
    apart = [(simhash.fingerprint(table[i].encode()) ^ simhash.fingerprint(table[i + 1].encode())).bit_count() for i in (0, 2, 4)]
    assert apart[0] <= 3 and apart[1] <= 3 < apart[2] and brute_similar(table) == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4, 5: 4}
    df = spark.createDataFrame([*table.items()], "doc_id long, text string").repartition(3)

    def kept():
        return {r.doc_id for r in corpus_pipeline.near_dedup(spark, df, SF).collect()}

    assert kept() == {0, 2, 3, 4}
    monkeypatch.setattr(similar, "rare_stars", lambda lists: lists.select(F.col("k").alias("a"), F.col("k").alias("b")).limit(0))
    assert kept() == {0, 2, 3, 4, 5}


def test_deduplicate_ids_with_several_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    table = [(1, a), (5, a), (5, b), (5, b), (5, b + " end"), (6, b), (7, c), (7, None), (7, ""), (None, c)]
    kept = simhash.deduplicate(spark.createDataFrame(table, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, (r.text or " ")[0]) for r in kept) == Counter([(1, "a"), (5, "b"), (7, "c"), (7, " "), (None, "c")])


# ---- suffixes


def brute_repeats(all_texts, length=200):
    data = [(t or "").encode() for t in all_texts]
    count = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        out.append((len(d), sum(gone), len(re.findall(rb"\x01+", gone)), hashlib.sha256(kept).hexdigest()))
    return out


REPEAT_COLS = ("n_bytes", "n_removed", "n_spans", "kept_sha256")


def test_suffixes_query_against_brute_force(spark, texts):
    got = {r.doc_id: tuple(r[c] for c in REPEAT_COLS) for r in queries.QUERIES["op7_suffixes"](spark, SF).collect()}
    assert got == dict(zip(texts, brute_repeats(texts.values()), strict=True))


@pytest.mark.parametrize("many", [20_000, 2])
def test_suffixes_on_tangled_repeats(spark, monkeypatch, many):
    monkeypatch.setattr(suffixes, "MANY", many)
    monkeypatch.setattr(suffixes, "GROUP", 7)
    rng = random.Random(11)
    base = "".join(rng.choice("abcdé ") for _ in range(3_000))
    made = ["a" * 1_000, "ab" * 300, "b" * 199, "b" * 200, base[:200], base[100:299]]
    for _ in range(30):
        a, n = rng.randrange(2_800), rng.choice([150, 199, 200, 201, 260, 700])
        noise = "".join(rng.choice("xyz") for _ in range(rng.randint(0, 300)))
        made.append(noise + base[a : a + n] + noise[::-1] + (base[a + 50 : a + n] if rng.random() < 0.4 else ""))
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: tuple(r[c] for c in REPEAT_COLS) for r in suffixes.remove_repeats(df, batches=3).collect()}
    assert got == dict(enumerate(brute_repeats(made)))


def test_suffix_pieces_overlap():
    rng = random.Random(2)
    text = bytes(rng.randrange(256) for _ in range(suffixes.PIECE + 5_000))
    which, start, n, _, _ = suffixes.runs_in([text], suffixes.Hasher(suffixes.PIECE), 200, 48)
    assert sorted(itertools.chain.from_iterable(range(s, s + m) for s, m in zip(start.tolist(), n.tolist(), strict=True))) == list(range(len(text) - 199))


def test_suffixes_odd(odd, none):
    got = rows(suffixes.remove_repeats(odd), "doc_id", *REPEAT_COLS[:3])
    small = [r for r in ODD if r[0] != 5]
    want = [(r[0], *b[:3]) for r, b in zip(small, brute_repeats([r[1] for r in small]), strict=True)]
    n = len(ODD[4][1])
    assert got == sorted([*want, (5, n, n, 1), (5, n, n, 1)], key=str)
    assert suffixes.remove_repeats(none).count() == 0


# ---- byte-level BPE


def ranks_file():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return f.read()


def test_bpe_against_tiktoken(spark, docs, texts, odd, none):
    data = ranks_file()
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}, special_tokens={})
    shared = spark.sparkContext.broadcast(data)
    listed = {r.doc_id: r.ids for r in bpe.encoded(docs, shared, public_tokenizers.PATTERN).collect()}
    got = {r.doc_id: r for r in queries.QUERIES["op9_byte_bpe"](spark, SF).collect()}
    assert got.keys() == texts.keys()
    for k, t in texts.items():
        ids = own.encode_ordinary(t)
        assert listed[k] == ids and got[k].n_tokens == len(ids)
        assert got[k].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    back = rows(bpe.encoded(odd, shared, public_tokenizers.PATTERN), "doc_id", "n_tokens", "decoded_sha256")
    assert back == sorted(((r[0], len(own.encode_ordinary(r[1] or "")), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in ODD), key=str)
    assert bpe.encoded(none, shared, public_tokenizers.PATTERN).count() == 0


def test_bpe_round_trip_of_every_byte():
    codec = bpe.Codec(ranks_file(), public_tokenizers.PATTERN)
    rng = random.Random(1)
    for _ in range(200):
        t = "".join(chr(rng.choice([rng.randrange(1, 0x250), rng.randrange(0x3000, 0x9FFF), rng.randrange(0x1F300, 0x1F700), 32, 10])) for _ in range(rng.randint(0, 60)))
        assert codec.decode(codec.encode(t)) == t.encode()


def test_bpe_keeps_what_comes_again(monkeypatch):
    """A full memory forgets only what has not been met lately: a word of every text is encoded once; borders between words change no ids."""
    monkeypatch.setattr(bpe, "MEMORY", 100)
    codec, sent = bpe.Codec(ranks_file(), public_tokenizers.PATTERN), []
    model = codec.model

    class Counting:
        def encode(self, given, **options):
            sent.append("\n".join([given] if isinstance(given, str) else given))
            return model.encode(given, **options)

    codec.model = Counting()
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for t, i in codec.rank.items()}, special_tokens={})
    texts = ["qzxjkvw " + " ".join(f"w{chr(97 + i % 26)}q{chr(97 + j)}zx" for j in range(i % 3, 26)) + " ÿ\n\xff\x00\n😀" for i in range(60)]
    for t in texts:
        assert codec.encode(t) == own.encode_ordinary(t)
    assert sum(x.split("\n").count("qzxjkvw") for x in sent) == 1


# ---- word pieces


def greedy(word, initial, continuing):
    i = n = 0
    while i < len(word):
        j = next((j for j in range(len(word), i, -1) if word[i:j] in (continuing if i else initial)), None)
        if j is None:
            return 0
        i, n = j, n + 1
    return n


def test_wordpiece_against_greedy_search():
    rng = random.Random(7)
    for _ in range(150):
        make = lambda: {"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, 8))}
        initial, continuing = make(), make()
        automaton = wordpiece.Automaton(initial, continuing)
        for _ in range(60):
            w = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 9)))
            assert automaton.count(w) == greedy(w, initial, continuing), (w, initial, continuing)


@pytest.fixture(scope="module")
def shared(spark):
    return wordpiece.vocabulary(spark, public_tokenizers.path(queries.PIECES))


@pytest.fixture(scope="module")
def pieces(shared):
    """Pieces of a word by greedy search."""
    initial, continuing = map(set, shared.value)
    return lru_cache(None)(lambda w: greedy(w, initial, continuing))


def test_wordpiece_query_against_greedy_search(spark, texts, odd, none, shared, pieces):
    got = {r.doc_id: r for r in queries.QUERIES["op8_token_counts"](spark, SF).collect()}
    assert got.keys() == texts.keys()
    for k in texts:
        counts = [pieces(w) for w in WORD.findall(texts[k])]
        assert (got[k].n_words, got[k].n_tokens, got[k].n_unknown) == (len(counts), sum(c or 1 for c in counts), counts.count(0))
    assert rows(wordpiece.token_counts(odd, shared, max_chars=100), "n_words") == sorted(((len(WORD.findall(r[1] or "")),) for r in ODD), key=str)
    assert wordpiece.token_counts(none, shared).count() == 0


# ---- personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(m):
    d = [int(c) for c in re.sub("[^0-9]", "", m)][::-1]
    return 13 <= len(d) <= 19 and sum(sum(divmod(2 * x, 10)) if i % 2 else x for i, x in enumerate(d)) % 10 == 0


VALID = {"email": lambda m: True, "ip": lambda m: all(int(p) <= 255 for p in m.split(".")), "card": luhn, "phone": lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15}


def brute_pii(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if VALID[k](m[0])]


def base_spans(df):
    return {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans if s.kind in pii.BASE] for r in pii.spans_of(df).collect()}


def test_pii_against_plain_patterns(docs, texts):
    assert base_spans(docs) == {k: brute_pii(t) for k, t in texts.items()}


def test_pii_on_hostile_strings(spark):
    rng = random.Random(13)
    bits = ["a@b.c", "_d@e.fr", "1.2.3.4", ".5.6", "256.1.1.1", "001.02.3.0", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (234) 555-0000", "+", "@", "é", "😀", " ", "0", "12", "-", ".", "GB82 WEST 1234 5698 7654 32", "token = " + "0a" * 20, "ssn 123-45-6789", "x", "\n"]
    made = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 25))) for _ in range(400)]
    made += ["1." * 50_000, "a" * 200_000, "9" * 100_000, "a.b@c" + ".d" * 50_000, "+1" + "(" * 100_000, "12 " * 50_000, "a@b.cc " * 700]
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").repartition(4)
    got = base_spans(df)
    for k, t in enumerate(made):
        if t in ("a" * 200_000, "9" * 100_000):
            assert got[k] == []
        else:
            assert got[k] == brute_pii(t), t[:80]


def test_pii_added_kinds_and_redaction(spark, odd, none):
    texts = ["pay to IBAN GB82 WEST 1234 5698 7654 32, not GB82 WEST 1234 5698 7654 33", "my ssn is 123-45-6789 but part 123-45-6789", "token = " + "0a" * 20 + " hash " + "0b" * 30, "mail a@b.cd 😀 card 4111 1111 1111 1111."]
    df = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: [(s.kind, texts[r.doc_id][s.start : s.end]) for s in r.spans] for r in pii.spans_of(df).collect()}
    assert got[0] == [("iban", "GB82 WEST 1234 5698 7654 32")]
    assert got[1][0] == ("ssn", "123-45-6789")
    assert got[2][0] == ("secret", "0a" * 20)
    assert got[3] == [("email", "a@b.cd"), ("card", "4111 1111 1111 1111")]
    clean = {r.doc_id: r for r in pii.redact(df).collect()}
    assert clean[3].text == "mail <EMAIL> 😀 card <CARD>." and clean[3].n_chars == len(clean[3].text)
    assert base_spans(odd.where("doc_id in (7, 8)")) == {k: brute_pii(ODD[6][1]) for k in (7, 8)}
    out = pii.redact(odd)
    assert out.columns == odd.columns and out.count() == len(ODD) and pii.redact(none).count() == 0
    assert rows(out.where("doc_id = 1"), "text", "n_chars") == [(None, None)]


def test_pii_account_numbers_before_other_words(spark):
    plain, spaced, other = "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "GB82WEST12345698765432"
    after = ["Thanks", "BIC COBADEFF", "2024 invoice", "X", "12", "and more", other, "or " + spaced, "A B C D E F G H I J K L M N", "", ". Next", "\u00e9"]
    texts = [f"IBAN {n} {a}" for n in (plain, spaced) for a in after] + [f"{plain} {spaced} {other}\n{plain}", f"x{plain}", f"{plain}0", f"{plain}a {other}", ("AB12 " * 20_000) + plain]
    found = [[n, *(x for x in (spaced, other) if x in a)] for n in (plain, spaced) for a in after] + [[plain, spaced, other, plain], [], [], [other], [plain]]
    df = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: [texts[r.doc_id][s.start : s.end] for s in r.spans if s.kind == "iban"] for r in pii.spans_of(df).collect()}
    assert got == dict(enumerate(found))
    clean = {r.doc_id: r.text for r in pii.redact(df.where("doc_id < 3")).collect()}
    assert clean == {i: f"IBAN <IBAN> {a}" for i, a in enumerate(after[:3])}


def test_pii_context_is_the_text_around(spark):
    """Lists under one label, rejected matches in between, and lists over several blocks, against the 40 code points before and after."""
    key = "0a" * 16
    lists = ["SSN: 123-45-6789, 234-56-7890, 345-67-8901", "Ssn 000-45-6789 123-45-6789", "123-45-6789 ssn", "ssn" + " " * 37 + "123-45-6789", "ssn" + " " * 38 + "123-45-6789", f"token: {key} {key}", f"É😀 Tokens {key[:-1]} é {key}"]
    lists += ["123-45-6789" + " " * 37 + "ssn", "123-45-6789" + " " * 38 + "ssn", "123-45-6789 234-56-7890 é tax", f"{key * 40} is a token"]
    lists += ["SSN " * k + "123-45-6789 " * n for k, n in ((1, 600), (9, 300))] + ["".join(f"123-45-678{i % 10} {'tax' if i % 64 == 63 else '-'} " for i in range(700))]
    df = spark.createDataFrame(list(enumerate(lists)), "doc_id long, text string")
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans if s.kind in ("ssn", "secret")] for r in pii.spans_of(df).collect()}
    for k, t in enumerate(lists):
        want = []
        for kind, pattern, words in (("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "ssn|social|tax"), ("secret", r"(?<![0-9A-Za-z])[0-9a-f]{32,}(?![0-9A-Za-z])", "token")):
            want += [(kind, m.start(), m.end()) for m in re.finditer(pattern, t) if not m[0].startswith("000") and (re.search(words, t[max(0, m.start() - 40) : m.start()].lower()) or re.search(words, t[m.end() : m.end() + 40].lower()))]
        assert got[k] == want, t[:80]
    assert [len(got[k]) for k in (0, 1, 2, 3, 4, 7, 8, 9, 10)] == [3, 1, 1, 1, 0, 1, 0, 2, 1]
    assert pii.redact(df.where("doc_id = 0")).first().text == "SSN: <SSN>, <SSN>, <SSN>"


def test_pii_query_against_its_sql(spark, tmp_path):
    """The given tables hold no account or social number, so the comparison runs over a table that does."""
    rng = random.Random(23)
    numbers = ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "GB82WEST12345698765432", "GB82 WEST 1234 5698 7654 33", "FR1420041010050500013M02606", "NO9386011117947", "AB12", "DE89 3704 0044 0532 0130 00 12"]
    bits = [*numbers, "123-45-6789", "000-12-3456", "9123-45-6789", "123-45-6789-", "SSN", "tax no.", "IBAN", "Thanks", "x", "é", "0a" * 20, "0b" * 90 + "G", "token", "a@b.cc", "+1 (234) 555-0000", "4111 1111 1111 1111", "10.0.0.1", "_", "-", "filler words of some length here"]
    made = [rng.choice(["", " ", ", "]).join(rng.choice(bits) for _ in range(rng.randint(1, 30))) for _ in range(500)] + [None, "", *numbers, *(f"my ssn: {x}" for x in numbers)]
    got = against_sql(spark, tmp_path, spark.createDataFrame(list(enumerate(made)), "doc_id long, text string"), "op2_pii")
    assert all(sum(f"{kind}:" in r["spans"] for r in got) > 20 for kind in ("iban", "ssn", "secret", "email", "ip", "card", "phone"))


# ---- lines


def brute_lines(table, ratio=lines.MAX_RATIO, least=1, whole=False):
    strip = lambda x: x.strip(" \t\x0b\x0c\r")
    total, pages = Counter(h for h, _ in table), Counter()
    for h, t in table:
        pages.update({(h, strip(x)) for x in (t or "").split("\n") if strip(x)})
    bad = {k for k, n in pages.items() if n >= least and n > ratio * total[k[0]]}
    out = []
    for h, t in table:
        kept = [x for x in (t or "").split("\n") if (h, strip(x)) not in bad]
        out.append(t if t is None or whole and not any(map(strip, kept)) else "\n".join(kept))
    return out


def test_lines_against_brute_force(spark, docs, odd, none):
    made = [("h" if i % 3 else None, "\n".join([" top ", f"own {i}", "", "rare" if i == 5 else "end\t", "top"])) for i in range(60)] + [("one", "top\nalone"), ("h", "top\nend"), ("h", None), ("h", "")]
    df = spark.createDataFrame([(i, h, t) for i, (h, t) in enumerate(made)], "page_id long, host string, body string")
    for least, whole in ((1, False), (5, True)):
        got = {r.page_id: r.body for r in lines.drop_boilerplate(df, host_col="host", text_col="body", max_ratio=0.5, min_pages=least, keep_whole=whole).collect()}
        assert got == dict(enumerate(brute_lines(made, 0.5, least, whole)))
        assert (got[60], got[61]) == (("top\nalone", "top\nend") if whole else ("", ""))
    table = [(r.source, r.text) for r in docs.orderBy("doc_id").collect()]
    got = [r.text for r in lines.drop_boilerplate(docs, host_col="source", text_col="text").orderBy("doc_id").collect()]
    assert got == brute_lines(table)
    out = lines.drop_boilerplate(odd, host_col="source", text_col="text", min_pages=5, keep_whole=True, count_cols=("n_lines", "n_dropped"))
    assert out.columns == [*odd.columns, "n_lines", "n_dropped"] and rows(out, "text") == sorted(((r[1],) for r in ODD), key=str)
    assert rows(lines.drop_boilerplate(odd, host_col="source", text_col="text"), "text") == sorted(((t,) for t in brute_lines([(r[3], r[1]) for r in ODD])), key=str)
    assert lines.drop_boilerplate(none, host_col="source", text_col="text").count() == 0


# ---- packing


def padding(histogram, bounds):
    return sum(n * (min(b for b in bounds if b >= x) - x) for x, n in histogram.items())


def test_boundaries_are_optimal():
    rng = random.Random(17)
    for _ in range(60):
        histogram = {rng.randint(0, 40): rng.randint(1, 9) for _ in range(rng.randint(1, 9))}
        k = rng.randint(1, 4)
        got = packing.boundaries(histogram, k)
        lengths = sorted(histogram)
        best = min(padding(histogram, [*c, lengths[-1]]) for m in range(k) for c in itertools.combinations(lengths[:-1], min(m, len(lengths) - 1)))
        assert len(got) <= k and padding(histogram, got) == best
    assert packing.boundaries({}, 3) == []


def check_packed(packed, lengths, max_length, budget):
    total, batches = Counter(), defaultdict(list)
    for r in packed:
        total[r.doc_id] += r.length
        assert r.start == r.piece * max_length and r.length <= r.bucket_length <= max_length
        batches[r.bucket_length, r.batch].append(r)
    assert total == Counter(lengths)
    by_bucket = Counter()
    for (b, _), members in batches.items():
        room = budget // max(b, 1)
        assert sorted(r.slot for r in members) == list(range(len(members))) and len(members) <= room
        by_bucket[b] += len(members) < room
    assert all(n <= 1 for n in by_bucket.values())  # only a bucket's last batch has room left


def test_packing_query_against_brute_force(spark, texts, pieces):
    packed = queries.QUERIES["op1_length_buckets"](spark, SF).collect()
    lengths = {k: sum(pieces(w) or 1 for w in WORD.findall(t)) for k, t in texts.items()}
    check_packed(packed, lengths, 2048, 65_536)
    histogram = Counter(r.length for r in packed)
    assert padding(histogram, {r.bucket_length for r in packed}) == padding(histogram, packing.boundaries(histogram, 16))


def test_packing_equal_rows(spark, monkeypatch):
    """A third of all rows share an id, and most of those a length."""
    monkeypatch.setattr(packing, "RUN", 100)
    table = [(None, 7)] * 450 + [(None, n % 30) for n in range(150)] + [(i, i % 50) for i in range(1200)]
    packed = packing.pack(spark.createDataFrame(table, "doc_id long, n long"), F.col("n"), max_length=32, n_buckets=4, token_budget=64).collect()
    want = Counter()
    for i, n in table:
        want[i] += n
    check_packed(packed, want, 32, 64)


def test_packing(docs, texts, odd, none):
    packed = packing.pack(docs, packing.word_count(F.col("text")), max_length=256, n_buckets=5, token_budget=1024).collect()
    check_packed(packed, {k: len(WORD.findall(t)) for k, t in texts.items()}, 256, 1024)
    got = packing.pack(odd, packing.word_count(F.col("text")), max_length=64, n_buckets=3, token_budget=128).collect()
    assert Counter(r.doc_id for r in got if r.piece == 0) == Counter(r[0] for r in ODD)
    assert packing.pack(none, F.col("n_chars")).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, F.col("n_chars"), max_length=10, token_budget=5)


# ---- search


def brute_search(table, queries, k):
    """table: (id, text); the k best (id, score) of each query id."""
    bags = [(i, Counter((t or "").encode().lower().split())) for i, t in table]
    mean = sum(sum(b.values()) for _, b in bags) / len(bags)
    df = Counter(w for _, b in bags for w in b)
    out = {}
    for q in queries:
        mine = next(b for i, b in bags if i == q)
        scores = []
        for i, b in bags:
            n = sum(b.values())
            s = sum(f * math.log(1 + (len(bags) - df[w] + 0.5) / (df[w] + 0.5)) * b[w] * 2.2 / (b[w] + 1.2 * (0.25 + 0.75 * n / mean)) for w, f in mine.items() if w in b)
            if s:
                scores.append((-round(s, 6), -1 if i is None else i))
        out[q] = sorted(scores)[:k]
    return out


def test_search_against_brute_force(docs, texts, odd, none):
    got = defaultdict(list)
    for r in search.top_k(docs, F.col("doc_id") % 20 == 0, k=7, shard_docs=60, query_terms=900).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.id, r.score))
    want = brute_search(list(texts.items()), [k for k in texts if k % 20 == 0], 7)
    assert got.keys() == want.keys()
    for q, found in want.items():
        assert [s for _, s in got[q]] == pytest.approx([-s for s, _ in found], abs=2e-6)
        assert {i for i, s in got[q] if s > -found[-1][0] + 2e-6} == {i for s, i in found if -s > -found[-1][0] + 2e-6}
    rows_ = search.top_k(odd, F.col("doc_id") % 5 == 0, k=3).collect()
    assert Counter(r.query_id for r in rows_)[5] == 3 and {r.id for r in rows_ if r.query_id == 10 and r.rank == 1} == {10}
    assert search.top_k(none, F.col("doc_id") % 5 == 0).count() == 0


def test_search_ties_and_odd_ids(spark):
    """300 copies tie exactly in every shard and go by id; text ids and a null one work; a query's own words alone count."""
    rows_ = [(f"c{i:03d}", "Same words here and there") for i in range(300)] + [(f"z{i}", f"other there {i} " * (i + 1)) for i in range(40)] + [(None, "same here"), ("lone", "nowhere"), ("mute", " ")]
    table = spark.createDataFrame(rows_, "doc_id string, text string").repartition(5)
    asked = F.col("doc_id").isin("c000", "c150", "lone", "mute", "z7")
    got = defaultdict(list)
    for r in search.top_k(table, asked, k=12, shard_docs=30, query_terms=4).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.id, r.score))
    assert [i for i, _ in got["c000"]] == [i for i, _ in got["c150"]] == [f"c{i:03d}" for i in range(12)]
    assert len({s for _, s in got["c000"]}) == 1
    assert [i for i, _ in got["lone"]] == ["lone"] and "mute" not in got
    assert len(got["z7"]) == 12 and all(i.startswith("z") for i, _ in got["z7"])


@pytest.mark.parametrize("columns", [0, 7, 1024])
def test_search_scores_frequent_terms_by_tiles(monkeypatch, columns):
    """Terms of a tenth of the documents need no postings, whole tiles are left out, and scores are exact however many terms are frequent."""
    monkeypatch.setattr(search, "COLUMNS", columns, raising=False)
    draw, size = random.Random(5), 620
    texts = [" ".join(draw.choices([f"{'ab'[i % 2]}{j}" for j in range(150)], k=draw.randint(8, 40)) + [f"rare{draw.randrange(900)}"]) for i in range(size)]
    texts[17] = texts[401] = texts[33]
    n, terms, counts = search._bags([t.encode() for t in texts])
    row = search._build(pa.int64())((pa.scalar(0),), pa.table({"id": pa.array(range(size)), "n": n, "terms": terms, "counts": counts}))
    mean, df = sum(n.to_pylist()) / size, Counter(t for bag in terms.to_pylist() for t in bag)
    picked = [0, 1, 17, 33, *range(50, size, 30)]
    bags = [sorted(zip(terms[i].as_py(), counts[i].as_py())) for i in picked]
    idf = {t: math.log(1 + (size - d + 0.5) / (d + 0.5)) for t, d in df.items()}
    columns_ = {"terms": [[t for t, _ in b] for b in bags], "weights": [[f * idf[t] for t, f in b] for b in bags], "dfs": [[df[t] for t, _ in b] for b in bags]}
    asked = search.Asked(pa.table({"query_id": pa.array(picked), **columns_}), size, pa.int64())
    shard = search.Shard({c: row.column(c).combine_chunks()[0].values for c in search.INDEX_LISTS}, asked.frequent, mean)
    want = brute_search(list(enumerate(texts)), picked, 6)
    read, ranges = [0], search._ranges
    monkeypatch.setattr(search, "_ranges", lambda starts, sizes: (read.append(int(np.sum(sizes))), ranges(starts, sizes))[1])
    for least in (np.zeros(len(picked)), np.array([-want[q][-1][0] for q in picked])):
        found = {picked[q]: (shard.ids.take(pa.array(docs)).to_pylist(), scores.tolist()) for q, docs, scores in shard.search(asked, 6, least.copy())}
        for q in picked:
            assert found[q][1] == pytest.approx([-s for s, _ in want[q]], abs=2e-6)
            assert {i for i, s in zip(*found[q]) if s > -want[q][-1][0] + 2e-6} == {i for s, i in want[q] if -s > -want[q][-1][0] + 2e-6}
        copies = [s for i, s in zip(*found[33]) if i in (17, 33, 401)]
        assert len(copies) == 3 and len(set(copies)) == 1 and found[33][0][:3] == [17, 33, 401]
    if columns == 1024:
        assert sum(read) == 2 * sum(df[t] for b in bags for t, _ in b if df[t] * 24 <= size)


def test_search_blocks_hold_at_most_so_many_terms(spark):
    sizes = [1, 3, 9, 2, 40, 5] * 20 + [300]
    df = spark.createDataFrame([(i, [0] * n) for i, n in enumerate(sizes)], "query_id long, terms array<long>")
    of, blocks = search.query_blocks(df, 100)
    held = [df.where(of.between(a, z)).agg(F.sum(F.size("terms")), F.max(F.size("terms"))).first() for a, z in blocks]
    assert sum(n for n, _ in held) == sum(sizes) and all(n <= 100 or most == 300 for n, most in held)
    assert sum(z - a + 1 for a, z in blocks) <= search.CLASSES * 13 and search.query_blocks(df.limit(0), 100)[1] == []


# ---- shards


def test_shards(spark, docs, odd, none):
    store = sharding.ShardStore(spark, scratch(spark, "test-shards"), target_bytes=60_000, tier_bytes=8_000, fanout=3, shard_rows=10)
    parts = [docs.where(F.col("doc_id") % 3 == k) for k in range(3)]
    for k, part in enumerate(parts):
        assert store.append(part) == k + 1
    before = store.manifest().count()
    last = store.compact()
    assert store.versions() == [*range(1, last + 1)] and store.manifest().count() < before
    assert store.manifest().where("bytes < 30000").groupBy("tier").count().where("count >= 3").count() == 0
    assert rows(store.read(), *docs.columns) == rows(docs, *docs.columns)
    assert store.manifest().agg(F.sum("n_rows")).first()[0] == docs.count()
    assert rows(store.read(1), *docs.columns) == rows(parts[0], *docs.columns)  # replaced shards are still there
    running = store.read(3)
    with pytest.raises(sharding.Conflict):
        store._commit(store.manifest(), None, last)
    assert store.expire(keep=last - 2) == 0 and rows(running, *docs.columns) == rows(docs, *docs.columns)
    assert store.expire() > 0 and store.versions() == [last]
    with pytest.raises(ValueError):
        store.read(1)
    assert rows(store.read(), *docs.columns) == rows(docs, *docs.columns)
    names = {r.s for r in store.read(shard_col="s").select("s").distinct().collect()}
    assert names == {r.path for r in store.manifest().collect()}


def test_shards_odd(spark, odd, none):
    store = sharding.ShardStore(spark, scratch(spark, "test-shards"), shard_rows=3, fanout=2)
    with pytest.raises(ValueError):
        store.read()
    assert store.compact() == 0 and store.expire() == 0
    clash = odd.withColumn("path", F.lit("p")).withColumn("_metadata", F.lit("m")).withColumn("removed", F.lit(1))
    assert store.append(clash.limit(0)) == 1 and store.read().columns == clash.columns and store.read(shard_col="at").count() == 0
    store.append(clash)
    store.append(clash.limit(0))
    store.compact()
    assert rows(store.read(), *odd.columns[:5]) == sorted(ODD, key=str) and store.read().columns == clash.columns
    assert store.manifest().agg(F.sum("n_rows")).first()[0] == len(ODD)


def test_shards_after_crashes(spark, docs, monkeypatch):
    """A writer dies at each of its steps; readers see the version before, and the next writer goes on."""
    part = docs.where("doc_id < 20")
    want, n = rows(part, *docs.columns), 0
    store = sharding.ShardStore(spark, scratch(spark, "test-shards"), fanout=2, lease=0)
    store.append(part)
    for step, times in (("_listing", ["after"]), ("_claim", ["before", "after"])):
        for when in times:
            plain = getattr(sharding.ShardStore, step)

            def dies(self, *args, plain=plain, when=when):
                if when == "after":
                    plain(self, *args)
                raise RuntimeError("crash")

            base = store._last()
            with monkeypatch.context() as m:
                m.setattr(sharding.ShardStore, step, dies)
                with pytest.raises(RuntimeError, match="crash"):
                    store.append(part)
            assert store._last() == base and store.read().count() == len(want) * (n + 1)
            store.append(part)
            n += 1
    held = sharding.ShardStore(spark, store.path)  # with a long lease
    held._claim(held._last() + 1)
    with pytest.raises(sharding.Conflict):
        held.append(part)
    slow = store._last() + 1
    store.append(part)  # the lease of this one is over at once, so it takes the claim
    assert store._last() == slow
    store.compact()
    store.expire(lease=0)
    assert rows(store.read(), *docs.columns) == sorted(want * (n + 2), key=str)
    found = sum(len(store._names(f"data/{f}")) for f in store._names("data"))
    assert found <= 2 * store.manifest().count() + len(store._names("data"))


def test_shards_list_all_now_and_then(spark, monkeypatch):
    monkeypatch.setattr(sharding, "FULL", 3)
    store = sharding.ShardStore(spark, scratch(spark, "test-shards"))
    for _ in range(4):
        store.append(spark.range(5).coalesce(1))
    assert "full=000003" in store._names("manifest")
    assert [store.read(v).count() for v in (1, 2, 3, 4)] == [5, 10, 15, 20]


# ---- pipeline


def test_pipeline_stages_against_brute_force(spark, docs, pieces):
    import corpus_pipeline as p

    now = docs
    for name, stage in p.STAGES[:-1]:
        before = [(r.doc_id, r.text, r.source) for r in now.orderBy("doc_id").collect()]
        now = stage(spark, now, SF)
        assert now.columns == docs.columns
        after = {r.doc_id: r.text for r in now.collect()}
        if name == "quality_rules":
            def good(t):
                n, chars, symbols, dup, rep = brute_quality(t)
                return not (n < 10 or 100 * rep > 20 * n or 10 * symbols > n or dup >= 10 and n < 5 * dup or chars < 2 * n or chars > 25 * n)
            assert after == {k: t for k, t, _ in before if good(t)}
        if name == "line_dedup":
            assert after == dict(zip((k for k, *_ in before), brute_lines([(s, t) for _, t, s in before], least=5, whole=True), strict=True))
        if name == "near_dedup":
            group = brute_similar({k: t for k, t, _ in before})
            assert after == {k: t for k, t, _ in before if group[k] == k}
        if name == "personal_data":
            assert after.keys() == {k for k, *_ in before}
            assert not any(brute_pii(t) for t in after.values())
    packed = p.run(spark, SF).collect()
    check_packed(packed, {k: sum(pieces(w) or 1 for w in WORD.findall(t)) for k, t in after.items()}, 2048, 65_536)


def test_pipeline_odd(spark, odd, none):
    import corpus_pipeline as p

    for given in (odd, none):
        for name, stage in p.STAGES:
            out = stage(spark, given, SF)
            assert name == "packing" or out.columns == given.columns
            out.collect()
