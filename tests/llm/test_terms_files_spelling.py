"""Source divergence, token-id files and spelling variants against plain versions, and their edge cases."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from tarnwork.llm import divergence, spelling, token_files
from tarnwork.llm.tokens import Encoder
from tarnwork.storage import new_path, stored

LETTERS = "abcdefghijklmnopqrstuvwxyz"
FOLD = str.maketrans(LETTERS.upper(), LETTERS)


def _table(spark, rows, extra=True):
    """Documents with columns that clash with those of the operators."""
    columns = "doc_id long, text string, lang string, source string"
    df = spark.createDataFrame(rows, columns)
    return df.withColumns({c: F.lit("x") for c in ("term", "word", "n", "id", "part", "rank", "value", "item", "file", "ids", "start", "batch", "sums", "place")}) if extra else df


# ------------------------------------------------------------------------ divergence


def _divergence(rows, min_docs, top):
    term = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = Counter(term.findall((text or "").translate(FOLD)))
        groups.add((lang, source))
        counts[lang, source].update(found)
        docs[lang].update(found.keys())
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        mine = sorted(s for x, s in groups if x == lang)
        table = {s: counts[lang, s] for s in mine}
        whole = sum(table.values(), Counter())

        def p(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        q, ps = p(whole), {s: p(table[s]) for s in mine}
        for s in mine:
            pairs = sorted((-sum(abs(ps[s][t] - ps[o][t]) for t in kept), o.encode(), o) for o in mine if o != s)
            out |= {(lang, s, "pair", o, -v, k) for k, (v, _, o) in enumerate(pairs, 1)}
            terms = sorted((q[t] - ps[s][t], t.encode(), t) for t in kept if table[s][t] and ps[s][t] > q[t])
            out |= {(lang, s, "term", t, -v, k) for k, (v, _, t) in enumerate(terms[:top], 1)}
    return out


def _prose(seed, n, words, sources=("a", "b", "c", "d")):
    rng = np.random.default_rng(seed)
    names = [f"{x}{y}" for x in ("mar", "ÉT", "São", "öl", "zz") for y in ("ten", "Ing", "ü", "kel", "漢")][:words]
    out = []
    for i in range(n):
        source = sources[int(rng.integers(len(sources)))]
        k = int(rng.integers(0, 12))
        out.append((i, " 7-".join(names[int(x) % len(names)] for x in rng.zipf(1.4, k) + ord(source[0])), "en" if i % 3 else "fr", source))
    return out


@pytest.mark.parametrize(("min_docs", "top"), [(3, 4), (1, 50), (10**6, 50)])
def test_divergence(spark, min_docs, top):
    """Also more than one source without any kept term, a language with one source, NULLs, repeated rows, NUL bytes."""
    rows = _prose(5, 160, 25) + [(i, None, "de", "only") for i in range(3)] + [(500, "", None, None), (501, "a\x00b A_b É", None, "s"), (501, "a\x00b A_b É", None, "s"), (None, "x y", "en", "empty"), (503, "7 8 9", "fr", "digits")]
    got = [tuple(r) for r in divergence.audit(_table(spark, rows), min_docs=min_docs, top=top).collect()]
    assert len(got) == len(set(got)) and set(got) == _divergence(rows, min_docs, top)


def test_divergence_flushes(spark, monkeypatch):
    """The same rows when tasks hand on their sums early."""
    rows = _prose(6, 90, 25) + [(900, "mar " * 5000, "en", "a")]
    want = _divergence(rows, 2, 50)
    monkeypatch.setattr(divergence, "FLUSH", 3)
    df = _table(spark, rows).repartition(3)
    sums = divergence.term_sums(df.select("lang", "source", "text"))
    assert sums.count() > sums.select("lang", "source", "term").distinct().count()
    assert {tuple(r) for r in divergence.audit(df, min_docs=2).collect()} == want


def test_divergence_empty(spark):
    df = divergence.audit(_table(spark, []))
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"] and df.count() == 0


def test_slices_cover_a_batch(monkeypatch):
    batch = pa.RecordBatch.from_pydict({"text": ["a" * 40, None, "", "b" * 5, "c" * 200, "d"]})
    for size in (1, 6, 45, 1000):
        monkeypatch.setattr(divergence, "SLICE_BYTES", size)
        parts = list(divergence._slices(batch, 0))
        assert [x for p in parts for x in p.column(0).to_pylist()] == batch.column(0).to_pylist() and all(p.num_rows for p in parts)


# ----------------------------------------------------------------------- token files


@pytest.mark.parametrize("n", [0, 1, 59, 1023, 1024, 1025, 4096, 9000])
@pytest.mark.parametrize("kind", ["tokens", "bits", "wide", "full", "equal"])
def test_blocks(n, kind):
    rng = np.random.default_rng(n)
    ids = {
        "tokens": rng.zipf(1.3, n) % 49408, "bits": rng.integers(0, 2, n), "equal": np.zeros(n), "full": rng.integers(0, 2**64, n, dtype=np.uint64),
        "wide": rng.integers(0, 2**63, n, dtype=np.uint64) >> rng.integers(0, 63, n, dtype=np.uint64),
    }[kind].astype(np.uint64)
    words, per, escapes = token_files.encode_blocks(ids)
    assert len(per) == len(escapes) == -(-n // token_files.BLOCK) and per.sum() == len(words)
    assert (token_files.decode_blocks(words, per, escapes, n) == ids).all()
    assert (escapes.sum() > 0) == bool((ids >= 2**60).any())
    if n >= 1024:
        a, b = 0, 1  # a block alone
        one = token_files.decode_blocks(words[: per[0]], per[a:b], escapes[a:b], 1024)
        assert (one == ids[:1024]).all()


def test_words_are_full():
    """Ids of w bits take the layout for w bits, and a wide id does not widen its neighbours' words."""
    for _, n, bits in token_files.LAYOUT:
        words, _, _ = token_files.encode_blocks(np.full(600, (1 << bits) - 1, np.uint64))
        assert len(words) == -(-600 // n) and len(set((words >> np.uint64(60)).tolist()[:-1])) == 1
    words, _, escapes = token_files.encode_blocks(np.array([1] * 60 + [2**61] + [1] * 60, np.uint64))
    assert len(words) == 4 and escapes.tolist() == [1]


def _want(docs):
    """Plain encoding in the order of ids (NULL first), ties by Spark's own hash of the text."""
    from tokenizers import Tokenizer

    tokenizer, out, at = Tokenizer.from_file(token_files.tokenizer_file()), [], 0
    for r in sorted(docs.withColumn("h", F.xxhash64("text")).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h)):
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2]
        out.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_token_files(spark):
    long = " ".join(f"w{i * 7919 % 3001}" for i in range(6000))
    texts = [None, "", "a", "It's 12's ü ÉCOLE 漢字 <|endoftext|>", long, "\n\n\n", "x" * 900, "same", "same"]
    rows = [(i * 3 % 11, t, "en", "s") for i, t in enumerate(texts)] + [(7, "same", "en", "s"), (4, long, "en", "s"), (4, "other", "en", "s"), (None, "no id", "en", "s")]
    df = _table(spark, rows).repartition(4)
    for size in (1 << 27, 50):  # one file a task, and several
        got = token_files.round_trip(stored(df, "docs"), ids_per_file=size).select("doc_id", "start", "n_tokens", F.crc32("ids")).collect()
        assert sorted(map(tuple, got), key=lambda r: r[1]) == _want(df)
    assert token_files.round_trip(df.limit(0)).count() == 0


def test_token_files_whole_table(spark):
    from tests.conftest import SF

    got = sorted(map(tuple, token_files.query(spark, SF).collect()))
    assert got == _want(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))


def test_encoder():
    """Words cut on bytes are those of the tokenizer, in every neighbourhood of its rules; other texts go to it whole."""
    from tokenizers import Tokenizer

    path = token_files.tokenizer_file()
    plain, encode, rng = Tokenizer.from_file(path), Encoder(path), random.Random(1)
    fixed = [
        None, "", "a", "it's we're 's ''s !'s 'sabc 'reve'll'd", "ÀÉ×÷ª²x³¼", "<|endoftext|> a", "漢字 abc", "x\x00y", "a\u00a0b", "don't 'T 'RE", "'", "'s", "'r", "'l", "s'", "12'34's", "\t\n x", "ÿß", "e\u0301", "'",
    ]
    letters = "abcST'' '\"!<|9²ÀÉ×ÿ\n\tµªrevltmd.,漢\u0301"
    for k in range(12):
        texts = fixed if not k else ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(200)]
        ids, begins = encode(pa.array(texts, pa.string()), 2)
        for i, t in enumerate(texts):
            assert ids[begins[i] : begins[i + 1]].tolist() == [*plain.encode(t or "", add_special_tokens=False).ids, 2], t
    other = Encoder(path)
    other.simple = False
    ids, begins = other(pa.array(fixed, pa.string()), 7)
    assert ids[begins[3] : begins[4]].tolist() == [*plain.encode(fixed[3], add_special_tokens=False).ids, 7]
    assert [len(x) for x in encode(pa.array([], pa.string()), 2)] == [0, 1]


def test_plain_words_go_to_the_model_alone():
    """Every plain character alone and in words, as the whole tokenizer codes them, and nothing goes to that again."""
    from tokenizers import Tokenizer

    path = token_files.tokenizer_file()
    whole, encode = Tokenizer.from_file(path), Encoder(path)
    chars = [chr(c) for c in [*range(0x20, 0x7F), *range(0xA1, 0x100)]]
    texts = [*chars, *[f"ab{c}Cd {c}{c} it's{c}" for c in chars], "", "plain words, plain words"]
    expected = [[*whole.encode(t, add_special_tokens=False).ids, 2] for t in texts]

    encode.tokenizer = None  # only texts that are not plain may need it
    ids, begins = encode(pa.array(texts), 2)
    assert [ids[a:b].tolist() for a, b in zip(begins, begins[1:])] == expected


def test_token_file_ranges(spark):
    """Any range of ids is read from its blocks; a file of another kind is refused; the files are smaller than plain 16-bit ids."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    folder = new_path(spark, "ids")
    files = stored(token_files.write(df, folder, token_files.tokenizer_file()), "files").collect()
    fs, root = pafs.FileSystem.from_uri(folder)
    for f in files:
        reader = token_files.Reader(fs, f.file)
        whole = reader.ids(0, reader.n_ids)
        assert len(whole) == f.ids and len(reader.keys) == f.docs
        for a, b in [(0, 1), (5, 2000), (1023, 1025), (f.ids - 1, f.ids), (7, f.ids)]:
            assert (reader.ids(a, b) == whole[a:b]).all()
        assert fs.get_file_info(f.file).size < 2.2 * f.ids + 16 * f.docs + 2000
    with fs.open_output_stream(f"{root}/other", compression=None) as out:
        out.write(b"x" * 200)
    with pytest.raises(ValueError, match="no token-id file"):
        token_files.Reader(fs, f"{root}/other")


def test_unreported_files_are_not_read(spark):
    """What a task left that did not finish is no part of the table."""
    df = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string")
    folder = new_path(spark, "ids")
    files = stored(token_files.write(df, folder, token_files.tokenizer_file()), "files")
    token_files.write(df, folder, token_files.tokenizer_file()).collect()
    assert sorted(r.doc_id for r in token_files.read(files, folder).collect()) == list(range(20))


# -------------------------------------------------------------------------- spelling


def _near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _spelling(rows, noise, min_length, min_count, ratio):
    counts = Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            at = h % len(run)
            counts[run[:at] + run[at + 1 :] if h % noise == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= min_length and n >= min_count}
    forms, near = {}, {}
    for w, n in words.items():
        found = sorted((-words[o], o) for o in words if _near(w, o))
        near[w] = len(found)
        if found and -found[0][0] >= ratio * n:
            forms[w] = found[0][1]
    out = set()
    for w, n in words.items():
        root = w
        while root in forms:
            root = forms[root]
        out.add((w, forms.get(w), root, n, near[w], words.get(forms.get(w))))
    return out


def _misspelt(seed, n):
    rng = np.random.default_rng(seed)
    base = ["letter", "lettre", "fenêtre", "aabbaa", "bookkeeper", "Ångström", "ÉTÉétéÉT", "zzzzzz", "banana"]
    letters = list("abetz") + ["é", "ÿ", "À"]
    out = []
    for i in range(n):
        words = []
        for _ in range(int(rng.integers(1, 30))):
            w = base[min(int(rng.zipf(1.3)) - 1, len(base) - 1)]
            while rng.random() < 0.35:
                k, c = int(rng.integers(len(w))), letters[int(rng.integers(len(letters)))]
                w = [w[:k] + w[k + 1 :], w[:k] + c + w[k + 1 :], w[:k] + c + w[k:]][int(rng.integers(3))] or "a"
            words.append(w.upper() if rng.random() < 0.1 else w)
        out.append((i, ["-", " ", "×7 ", "Ā"][i % 4].join(words), "en", "s"))
    return out


@pytest.mark.parametrize(("noise", "min_length", "min_count", "ratio", "bits"), [(199, 6, 5, 5, 64), (7, 3, 2, 2, 64), (3, 1, 1, 3, 64), (7, 3, 2, 2, 9), (5, 2, 1, 2, 3)])
def test_spelling(spark, noise, min_length, min_count, ratio, bits):
    """``bits`` of a few make keys collide: the strings decide, so the rows stay the same."""
    rows = _misspelt(noise, 150) + [(None, "letter letter", "en", "s"), (900, None, "en", "s"), (901, "", "en", "s"), (902, "letter " * 50, "en", "s"), (902, "letter " * 50, "en", "s")]
    got = [tuple(r) for r in spelling.variants(_table(spark, rows).repartition(3), noise=noise, min_length=min_length, min_count=min_count, ratio=ratio, bits=bits).collect()]
    want = _spelling(rows, noise, min_length, min_count, ratio)
    assert len(got) == len(set(got)) and set(got) == want
    assert any(r[1] for r in want) and (ratio > 2 or any(r[1] and r[1] != r[2] for r in want))


def test_spelling_long_words_and_flushes(spark, monkeypatch):
    """Words of thousands of letters, alike but for one, and counts that are handed on early."""
    monkeypatch.setattr(spelling, "FLUSH", 4)
    monkeypatch.setattr(spelling, "KEY_ROWS", 10)
    long = "abcde" * 1500
    rows = [(i, f"{long} {long[:4000]}x{long[4001:]} {'a' * 3000} {'a' * 3001} {long[1:]}", "en", "s") for i in range(2)] + [(i, long, "en", "s") for i in range(2, 9)]
    got = {tuple(r) for r in spelling.variants(_table(spark, rows), min_count=2).collect()}
    assert got == _spelling(rows, 199, 6, 2, 5)


def test_spelling_empty(spark):
    df = spelling.variants(_table(spark, []))
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"] and df.count() == 0
    assert spelling.variants(_table(spark, [(1, "ab cd", "en", "s")])).count() == 0


def test_crc32_of_spans():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    starts = rng.integers(0, 4000, 300)
    ends = starts + rng.integers(0, 60, 300)
    ends[:2] += 900
    got = spelling.crc32_spans(data, starts, ends, np.array([zlib.crc32(f"{i}:".encode()) for i in range(300)], np.uint32))
    assert got.tolist() == [zlib.crc32(f"{i}:".encode() + data[a:b].tobytes()) for i, (a, b) in enumerate(zip(starts, ends))]


def test_key_skew_is_bounded(spark):
    """Words that share a deletion are few, however often each stands in the texts."""
    rows = [(i, " ".join(f"house{a}" for a in LETTERS), "en", "s") for i in range(300)]
    words = stored(spelling.word_counts(_table(spark, rows), noise=10**9).withColumn("id", F.monotonically_increasing_id()), "words")
    assert words.count() == 26 and spelling.meeting(words).count() <= 26 * 14
    got = {(r.word, r.n_near) for r in spelling.variants(_table(spark, rows), noise=10**9).collect()}
    assert got == {(f"house{a}", 25) for a in LETTERS}
