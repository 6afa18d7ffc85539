"""Byte-level BPE, alignment of tokenizers and phrases against libraries and brute force, with hard rows."""

import base64
import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken

from orrery.llm import alignment, bytebpe, phrases, queries

A, B, RANKS = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), P.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, n long, row string, ids string"
SF = "/root/testdata/sf0.001"
ODD = ["a", "b", "the", "'", "'s", "'re", "re", " ", "  ", "\n", "\t", "1", "22", "!", "!!", "\u00e9", "\u6f22", "x" * 50, "'l", "l", "T", "\xa0", "\u2581", "\x00", "\ufb01", "<s>", "<0x41>", "<|endoftext|>", "\r\n", "\x1c", "\u3000", "e\u0301", "\U0001f600"]


def odd_texts(n, seed=3):
    r = random.Random(seed)
    return [None, "", " ", "\n", " \n ", "\u2581", *("".join(r.choice(ODD) for _ in range(r.randint(0, 40))) for _ in range(n))]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k if k % 50 else None, t, ["en", "de", None][k % 3], k, "clash", "clash") for k, t in enumerate(odd_texts(300))]
    return spark.createDataFrame(rows + rows[:40], SCHEMA).cache()


@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def digest(x):
    return hashlib.sha256(x).hexdigest()


def test_bpe_tree_equals_the_library(tik, monkeypatch):
    r = random.Random(4)
    codec = bytebpe.Codec(bytebpe.ranks_of(RANKS), P.PATTERN)
    monkeypatch.setattr(bytebpe, "KEPT_CHARS", 4)
    for leaf, leaf_bytes in ((1, 4), (2, 32), (3, 4), (7, 4), (50, 8), (1 << 15, 32)):
        monkeypatch.setattr(bytebpe, "LEAF", leaf)
        monkeypatch.setattr(bytebpe, "LEAF_BYTES", leaf_bytes)
        for text in [*odd_texts(300, leaf), *("".join(r.choice(["a", "ab", "th", "e", r.choice("abcdefgh") * r.randint(1, 40), " ", "'", "re"]) for _ in range(50)) for _ in range(150))]:
            ids = codec.encode(text or "")
            assert ids.tolist() == tik.encode_ordinary(text or ""), (leaf, text)
            assert codec.decode(ids) == (text or "").encode()


def test_bpe_of_very_long_matches(tik):
    codec = bytebpe.Codec(bytebpe.ranks_of(RANKS), P.PATTERN)
    r = random.Random(5)
    for text in ("a" * 100_000, "abc" * 30_000, " " * 90_000, "".join(r.choice("abcdefghij") for _ in range(90_000)), "!?" * 40_000, "a b " * 30_000):
        assert codec.encode(text).tolist() == tik.encode_ordinary(text)


def test_join_is_the_encoding_of_both():
    ranks = bytebpe.ranks_of(RANKS)
    r = random.Random(6)
    for _ in range(2000):
        data = bytes(r.choice(b"aaabbcdething ") for _ in range(r.randint(0, 60)))
        cut = r.randint(0, len(data))
        assert bytebpe.join(bytebpe.merge(data[:cut], ranks), bytebpe.merge(data[cut:], ranks), ranks) == bytebpe.merge(data, ranks)


def test_bpe_digests(docs, tik):
    got = bytebpe.digests(docs, RANKS, P.PATTERN).collect()
    want = []
    for r in docs.collect():
        ids = tik.encode_ordinary(r["text"] or "")
        want.append((r["doc_id"], len(ids), digest(" ".join(map(str, ids)).encode()), digest((r["text"] or "").encode())))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert bytebpe.digests(docs.limit(0), RANKS, P.PATTERN).count() == 0
    assert sorted(str(r["ids"]) for r in bytebpe.encoded(docs, RANKS, P.PATTERN).collect()) == sorted(str(tik.encode_ordinary(r["text"] or "")) for r in docs.collect())


def grouped(pair, text):
    """Groups of one text by sets of byte places, from the whole text's tokens."""
    if not text:
        return [], [], []
    a, b, want = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text), (" " + text).encode()
    ends = []
    for ids, table in ((a, pair.a_bytes), (b, pair.b_bytes)):
        if b"".join(table[i] for i in ids) != want:
            return [], [], []
        at, each = 0, []
        for i in ids:
            at += len(table[i])
            each.append(at)
        ends.append(each)
    out, start = [], 0
    for stop in sorted(set(ends[0]) & set(ends[1])):
        out.append(([i for i, e in zip(a, ends[0]) if start < e <= stop], [i for i, e in zip(b, ends[1]) if start < e <= stop]))
        start = stop
    return a, b, out


def test_alignment(docs):
    pair = alignment.Pair(A, B)
    rows = [(r["doc_id"], *grouped(pair, r["text"])) for r in docs.collect()]
    count = Counter((g[0][-1], g[1][-1]) for *_, groups in rows for g in groups)
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    want = []
    for doc_id, a, b, groups in rows:
        links = [(g[0][-1], g[1][-1]) for g in groups]
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        want.append((doc_id, len(a), len(b), len(groups), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), digest(said.encode()) if groups else ""))
    got = alignment.align(docs, A, B).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert sum(x[1] > 0 for x in want) > 100 and sum(x[1] == 0 for x in want) > 5
    assert alignment.align(docs.limit(0), A, B).count() == 0


def test_alignment_of_a_long_text():
    pair = alignment.Pair(A, B)
    r = random.Random(9)
    text = "".join(r.choice(ODD[:26]) for _ in range(3000)).replace("\u2581", "") + "z" * 5000
    a, b, groups = grouped(pair, text)
    said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
    got = next(iter(list(pair.texts([text]))))
    assert got[:3] == (len(a), len(b), said) and len(groups) > 1000
    linkable = sum(map(len, pair.a_bytes.values())) + sum(map(len, pair.b_bytes))
    assert linkable < 700_000  # the bound of the broadcast


def brute_phrases(rows, most=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        n[lang] += 0
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, c in f.items():
        hidden = Counter()
        for p, a in c.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    hidden[p[i : i + k]] = max(hidden[p[i : i + k]], a if a >= 30 else 0)
        kept = []
        for p, a in c.items():
            if len(p) >= 2 and a >= 30 and not (hidden[p] and 100 * hidden[p] >= 80 * a):
                s, k = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
                kept.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(kept)[:most])]
    return sorted(out)


@pytest.fixture(scope="module")
def prose(spark):
    r = random.Random(7)
    words = ["of", "the", "New", "york", "stock", "exchange", "a", "rose", "is", "\u00e9t\u00e9", "x\x1cy", "\xa0"]
    say = lambda: " ".join(r.choice([r.choice(words), "new york", "New York stock exchange", "of the", "a rose is a rose"]) + r.choice(["", "", "", ",", ".\n", "\t"]) for _ in range(60))
    rows = [(k, say(), ["en", "de", None, "und", ""][k % 5], 1, "clash", "clash") for k in range(200)]
    rows += [(None, None, "en", 1, "", ""), (None, "", None, 1, "", ""), (7, "the same the same " * 3000, "fr", 1, "", ""), (8, ". , ; !", "es", 1, "", ""), (9, "only once here", "it", 1, "", "")]
    rows += [(1, "hot pair " + r.choice(words) + " " + r.choice(words), "en", 1, "", "") for _ in range(300)]
    return spark.createDataFrame(rows + rows[:5], SCHEMA).cache()


def test_phrases(prose, monkeypatch):
    want = brute_phrases([(r["text"], r["lang"]) for r in prose.collect()])
    assert len(want) > 50
    for task, hot in ((phrases.TASK_ROWS, phrases.HOT_ROWS), (20, 0)):  # also with every prefix dealt by its third word
        monkeypatch.setattr(phrases, "TASK_ROWS", task)
        monkeypatch.setattr(phrases, "HOT_ROWS", hot)
        got = phrases.collocations(prose.repartition(3)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
        assert sorted(map(tuple, got.collect())) == want
    assert [x for x in sorted(map(tuple, phrases.collocations(prose, most=3).collect()))] == [x for x in want if x[1] <= 3]
    assert phrases.collocations(prose.limit(0)).count() == 0


def test_phrases_with_full_slots(prose, monkeypatch):
    """Arrays too small to prune anything change nothing."""
    monkeypatch.setattr(phrases, "SLOT_BITS", (3, 3))
    assert sorted(map(tuple, phrases.collocations(prose).collect())) == brute_phrases([(r["text"], r["lang"]) for r in prose.collect()])


def test_phrases_read_the_table_four_times(prose, tmp_path):
    """The words of each language are counted with the first slots, by no reading of their own."""
    readings = tmp_path / "readings"

    def noted(batches):
        with open(readings, "a") as f:
            f.write("x")
        yield from batches

    assert phrases.collocations(prose.coalesce(1).mapInArrow(noted, prose.schema)).count() > 50
    assert readings.read_text() == "xxxx"


def test_words_of_blocks():
    """Small batches are read together; words, pieces and hashes are those of the texts, whatever the words' lengths."""
    r = random.Random(5)
    odd = ["a" * k + z for k in (0, 1, 6, 7, 8, 14, 15, 16, 62, 63, 64, 65, 200) for z in "bc\x00\u00e9"] + ["x\x1cy", "\xa0", "NEW", "new"]
    texts = ["".join(r.choice(odd) + r.choice([" ", " \t ", ", ", "\r\n", " . ; "]) for _ in range(r.randrange(40))) for _ in range(60)]
    rows = [(r.choice(["en", "de", ""]), t) for t in [*texts, "", None, "end", "", "of text", " ", ".", " x", "x "]]
    batches = [pa.record_batch([pa.array(x, pa.string()) for x in zip(*rows[at : at + 7], strict=True)], ["lang", "text"]) for at in range(0, len(rows), 7)]
    assert [b.num_rows for b in phrases.blocks(iter(batches))] == [len(rows)]
    assert sum(b.num_rows for b in phrases.blocks(iter(batches), 500)) == len(rows) and len(list(phrases.blocks(iter(batches), 500))) > 5
    block = next(phrases.blocks(iter(batches)))
    words = phrases.Words(block)
    want = []
    for lang, text in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            found = re.findall("[^\x20\x09]+", piece)
            want += [(lang, w, i + 1 < len(found)) for i, w in enumerate(found)]
    number, names = words.numbered()
    names, langs = names.to_pylist(), words.langs.to_pylist()
    got = [(langs[k], names[i], go) for k, i, go in zip(words.lang.tolist(), number.tolist(), words.goes_on.tolist(), strict=True)]
    assert got == want and len(want) > 500
    of = defaultdict(set)
    for (lang, w, _), h in zip(got, words.hashes.tolist(), strict=True):
        of[lang, w].add(h)
    assert all(len(x) == 1 for x in of.values()) and len(set.union(*of.values())) == len(of)
    assert [list(x) for x in phrases.Words(block.slice(0, 0)).may_begin([])[0]] == [[]]


def test_slots_travel_whole():
    counts = np.zeros(1 << 20, np.uint8)
    at = np.unique(np.random.default_rng(1).integers(0, 1 << 19, 5000)) + (1 << 18)
    counts[at] = np.arange(len(at)) % 255 + 1
    back = np.zeros_like(counts)
    rows = phrases.slot_rows(counts, {"en": 5}).to_pylist()
    for x in rows[:-1]:
        back[(x["row"] << phrases.ROW_BITS) + phrases.met_slots(x["at"])] = np.frombuffer(x["times"], np.uint8)
    assert (back == counts).all() and rows[-1] == {"row": None, "at": None, "times": None, "lang": "en", "n": 5}


def test_phrase_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    found = con.execute(queries.ORACLE["op12_phrases"])
    columns = [x[0] for x in found.description]
    got = queries.op12_phrases(spark, SF)
    assert got.columns == columns and sorted(map(tuple, got.collect())) == sorted(found.fetchall())


def test_scores_past_64_bits(spark):
    big = 5 * 10**14
    rows = [("en", "a", 1, big), ("en", "b", 1, big), ("en", "a b", 2, big - 1)]
    got = phrases.score(spark.createDataFrame(rows, "lang string, phrase string, k int, a long")).collect()
    assert [r["score"] for r in got] == [2_000_000 * (big - 1) // (2 * big)]


def test_tasks_of_one_process_share_what_they_remember():
    codec = bytebpe.codec_of(RANKS, P.PATTERN)
    codec.encode(" abcdexyz")
    again = bytebpe.codec_of(RANKS, P.PATTERN)
    assert again is codec and " abcdexyz" in again.kept
    assert alignment.pair_of(A, B) is alignment.pair_of(A, B)
    for text in ("", "x", "unbelievable", "aaaaaaaaaaa", "zürück…", "   \n"):
        assert codec.encode(text).tolist() == tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={}).encode_ordinary(text)
