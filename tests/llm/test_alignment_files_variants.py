"""Cross-tokenizer alignment, token files and spelling variants against plain versions."""

import hashlib
import posixpath
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from lexloom.llm import alignment, common, queries, token_files, variants, wordwise
from pyspark.sql import functions as F
from tokenizers import Tokenizer

BYTE, WORD, PIECE = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
ODD = [
    "", " ", "  a  b", "a\n b \n\n c", "it's We'LL don't. 's", "x<|endoftext|>y <|startoftext|> z <s> </s> <unk>", "é é a ́b", "ÀÉ ßẞ İ ǅ Σς ΣΑΣ",
    "日本語 テスト。", "a\x1cb\x85c\xa0d e", "1234 5,6. a1b2 ...,,; !?", "ends ", "\ttab\r\nx", "w" * 300, "a b" * 50, "so­ft", "× ÷ a×b", "\U0001f642 \U0001f469‍\U0001f467 x", "\x00 a\x00b",
    "a▁b", "▁", "ａﬁ ½", "long " + "xé" * 3000, "The house. The House, the house; THE HOUSE",
]


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


@pytest.fixture(scope="module")
def odd_texts(spark, odd_docs):
    more = spark.createDataFrame([(1000 + k, t) for k, t in enumerate(ODD)], "doc_id long, text string")
    return odd_docs.unionByName(more, allowMissingColumns=True).repartition(3).cache()


def odd_strings(signs, n=600):
    rng = random.Random(3)
    return ODD + ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(n)]


@pytest.mark.parametrize("apart", [True, False])
def test_encoder_gives_the_library_s_ids(monkeypatch, apart):
    monkeypatch.setattr(wordwise, "KEPT", 60)  # what is not kept is looked up again
    monkeypatch.setattr(wordwise, "TOGETHER", 7)
    own, library = wordwise.Encoder(WORD), Tokenizer.from_file(WORD)
    assert own.apart and own.dtype.itemsize == 2
    own.apart = apart
    texts = odd_strings("ab cD'é́ .,\n\t<|>5 中  s")
    for k in range(0, len(texts), 100):
        ids, starts = own.encode(pa.array(texts)[k : k + 100])
        want = [e.ids for e in library.encode_batch(texts[k : k + 100], add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == want


def test_other_vocabularies_see_whole_texts():
    assert not wordwise.drops_space({"model": {"type": "BPE"}, "pre_tokenizer": {"type": "Whitespace"}})
    assert not wordwise.Encoder(BYTE).apart


def test_byte_level_ids_are_the_library_s():
    own, library = alignment.Bytes(BYTE), Tokenizer.from_file(BYTE)
    library.encode_special_tokens = True
    assert own.fast
    texts = odd_strings("ab cD'é́ .,\n\t<|>5 中  s", 2000) + [" " * 999 + "x", "a" + " " * 50_000 + "b", "\n" * 30_000, "\t" * 1001 + "x", "x" * 100_000, "é" * 50_000, "ab1" * 20_000]
    for text in texts:
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids


# ---------------------------------------------------------------- token files


def plain_tokens(rows):
    """(doc_id, start, n_tokens, crc32) with the library alone; rows that repeat an id in any order of their own."""
    library = Tokenizer.from_file(WORD)
    ids = [[*e.ids, 1] for e in library.encode_batch([t or "" for _, t in rows], add_special_tokens=False)]
    return [(d, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (d, _), x in zip(rows, ids, strict=True)]


def check_tokens(got, want):
    got = sorted(got, key=lambda r: r[1])
    at = 0
    for _, start, n, _ in got:
        assert start == at
        at += n
    names = [r[0] for r in got]
    known = [n for n in names if n is not None]
    assert known == sorted(known) and names == known + [None] * (len(names) - len(known))
    assert sorted(((d, n, crc) for d, _, n, crc in got), key=repr) == sorted(want, key=repr)


def test_token_files(odd_texts):
    docs = odd_texts.selectExpr("*", "1 AS id", "2 AS hash", "3 AS start", "'x' AS ids", "4 AS shard")
    made = token_files.token_files(docs, WORD, shard_bytes=20_000)
    assert made.columns == ["doc_id", "start", "n_tokens", "ids"]
    check_tokens([tuple(r) for r in made.select("doc_id", "start", "n_tokens", F.crc32("ids")).collect()], plain_tokens(rows_of(odd_texts)))


def test_token_files_on_disk(spark, odd_docs, tmp_path):
    out = f"file://{tmp_path}/ids"
    token_files.write_tokens(odd_docs, out, WORD, shard_bytes=50_000)
    listed = sorted(token_files.manifest(spark, out).collect(), key=lambda r: r.shard)
    assert len(listed) > 2 and listed[-1].nulls == 2 and all(r.width == 2 for r in listed)
    docs = ids = 0
    for r in listed:
        path = lambda kind: str(tmp_path / "ids" / token_files.name_of(kind, r.shard))  # noqa: E731, B023
        assert (r.base_docs, r.base_ids) == (docs, ids)
        own, starts = np.memmap(path("ids"), "<u2", "r"), np.memmap(path("offsets"), "<u8", "r")
        assert (len(own), len(starts), len(np.memmap(path("docs"), "<i8", "r"))) == (r.ids, r.docs + 1, r.docs)
        assert int(starts[0]) == ids and all(own[int(e) - ids - 1] == 1 for e in starts[1:])
        docs, ids = docs + r.docs, ids + r.ids
    assert not list((tmp_path / "ids" / "_temporary").iterdir())
    # Again into the same folder: the same bytes.
    before = {p.name: p.read_bytes() for p in (tmp_path / "ids").glob("*.bin")}
    token_files.write_tokens(odd_docs, out, WORD, shard_bytes=50_000)
    assert before == {p.name: p.read_bytes() for p in (tmp_path / "ids").glob("*.bin")}


def test_token_files_of_one_id_and_of_none(spark, no_docs):
    docs = spark.range(3000).selectExpr("IF(id % 3 = 0, 7, id) AS doc_id", "concat('word ', id % 5) AS text")
    made = token_files.token_files(docs, WORD, shard_bytes=1000).select("doc_id", "start", "n_tokens", F.crc32("ids"))
    check_tokens([tuple(r) for r in made.collect()], plain_tokens(rows_of(docs)))
    assert token_files.token_files(no_docs, WORD).count() == 0


def test_token_files_that_were_cut_short_are_refused(spark, odd_docs, tmp_path):
    out = f"file://{tmp_path}/ids"
    token_files.write_tokens(odd_docs, out, WORD)
    file = tmp_path / "ids" / token_files.name_of("ids", 0)
    file.write_bytes(file.read_bytes()[:-2])
    with pytest.raises(Exception, match="lengths that the manifest gives"):
        token_files.read_tokens(spark, out).collect()


# ---------------------------------------------------------------- alignment


def plain_alignment(rows):
    """The contract with plain loops: (doc_id, n_a, n_b, n_groups, groups, links)."""
    library, pieces = Tokenizer.from_file(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    library.encode_special_tokens = True
    letters = {v: k for k, v in alignment.byte_letters().items()}
    back = {v: k for k, v in letters.items()}
    a_bytes = {k: bytes(back[c] for c in p) for p, k in library.get_vocab().items() if p != "<|endoftext|>"}
    out = []
    for doc_id, text in rows:
        want = (" " + (text or "")).encode()
        a = library.encode(" " + (text or ""), add_special_tokens=False).ids
        b = pieces.encode(text or "")
        raw_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in (pieces.id_to_piece(k) for k in b)]
        raw_a = [a_bytes[k] for k in a]
        if not text or b"".join(raw_a) != want or b"".join(raw_b) != want:
            out.append((doc_id, 0, 0, 0, "", []))
            continue
        spans = []
        for raw in (raw_a, raw_b):
            at, own = 0, []
            for x in raw:
                own.append((at, at + len(x)))
                at += len(x)
            spans.append(own)
        links = [(i, j) for k, (i, (p, q)) in enumerate(zip(a, spans[0])) for j, (r, s) in zip(b, spans[1]) if max(p, r) < min(q, s)]
        shared = sorted({q for _, q in spans[0]} & {q for _, q in spans[1]})
        groups, last = [], 0
        for end in shared:
            groups.append("|".join(",".join(str(i) for i, (p, q) in zip(ids, own) if last <= p and q <= end) for ids, own in zip((a, b), spans)))
            last = end
        out.append((doc_id, len(a), len(b), len(groups), ";".join(groups), links))
    counts = Counter(x for r in out for x in r[5])
    most = {}
    for (_, j), n in counts.items():
        most[j] = max(most.get(j, 0), n)
    return [(*r[:4], len(r[5]), sum(counts[x] == most[x[1]] for x in r[5]), sum(counts[x] for x in r[5]), hashlib.sha256(r[4].encode()).hexdigest() if r[4] else "") for r in out]


def short(docs):
    """The plain version compares all tokens with all."""
    return docs.where("text IS NULL OR length(text) < 7000")


@pytest.mark.parametrize("often", [alignment.COMMON, 10, 1])
def test_alignment(odd_texts, often):
    docs = short(odd_texts)
    rows = alignment.align(docs.selectExpr("*", "1 AS row", "2 AS pairs", "'x' AS groups", "1 AS id"), BYTE, PIECE)
    rows = rows.withColumn("sha", F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))).drop("groups")
    got = alignment.with_link_counts(rows, 32_000, often).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "sha")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(plain_alignment(rows_of(docs)), key=repr)


def test_alignment_of_very_long_texts_and_of_none(spark, no_docs):
    long = " ".join(f"w{k % 977}" for k in range(60_000)) + "x" * 20_000
    [got] = alignment.alignment(spark.createDataFrame([(1, long)], "doc_id long, text string"), BYTE, PIECE).collect()
    parts = [tuple([int(x) for x in side.split(",")] for side in g.split("|")) for g in got.groups.split(";")]
    assert len(parts) == got.n_groups and sum(len(a) for a, _ in parts) == got.n_a and sum(len(b) for _, b in parts) == got.n_b
    own = alignment.aligner(BYTE, PIECE)
    assert b"".join(own.a_bytes[k] for a, _ in parts for k in a) == (" " + long).encode() == b"".join(own.b_bytes[k] for _, b in parts for k in b)
    assert alignment.alignment(no_docs, BYTE, PIECE, digest=True).count() == 0


# ---------------------------------------------------------------- spelling variants


def plain_words(rows, noise=199):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if noise and h % noise == 0 else run] += 1
    return counts


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(counts, least=5, shortest=6, factor=5):
    words = {w: n for w, n in counts.items() if len(w) >= shortest and n >= least}
    forms, out = {}, {}
    for w, n in words.items():
        beside = [v for v in words if near(w, v)]
        top = min(beside, key=lambda v: (-words[v], v), default=None)
        forms[w] = top if top is not None and words[top] >= factor * n else None
        out[w] = [n, len(beside), forms[w], words[top] if forms[w] else None]
    for w in words:
        root = w
        while forms[root]:
            root = forms[root]
        out[w].append(root)
    return sorted(((w, *x) for w, x in out.items()), key=repr)


def texts_of(seed, n, alphabet, longest=9):
    """Words that are near one another, with very uneven counts."""
    rng = random.Random(seed)
    words = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(5, longest))) for _ in range(40)]
    for _ in range(120):
        w = rng.choice(words)
        k = rng.randrange(len(w))
        words.append(rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice(alphabet) + w[k:], w[:k] + rng.choice(alphabet) + w[k + 1 :]]))
    many = [w for w in words for _ in range(rng.choice([1, 4, 5, 6, 30, 200, 1200]))]
    rng.shuffle(many)
    return [(k, " ".join(many[k::n])) for k in range(n)]


@pytest.mark.parametrize("noise", [0, 199, 3])
def test_spelling_variants(spark, noise):
    rows = [*texts_of(1, 50, "abéE"), *texts_of(2, 30, "aB"), (None, "aaaaaaa " * 9), (None, None), (7, ""), (7, "Étés-ÉTÉS x×y " * 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS at", "2 AS n", "'x' AS word", "'y' AS form")
    got = variants.spelling_variants(docs.repartition(3), noise=noise).select("word", "n", "n_near", "form", "form_n", "root")
    want = plain_variants(plain_words(rows, noise))
    assert len(want) > 60 and any(w[5] not in (w[0], w[3]) for w in want)  # ways of two steps and more
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want


@pytest.mark.parametrize("exact", [0, 5, 6, 7, 64])
def test_groups_named_by_hashes(spark, exact):
    words = sorted({w for _, t in texts_of(4, 3, "ab", 10) for w in t.split()})
    rows = spark.createDataFrame([(k, w, len(w) * 7 + k % 3) for k, w in enumerate(words)], "at long, word string, n long")
    n = {w: len(w) * 7 + k % 3 for k, w in enumerate(words)}
    got = {words[r.at]: (r.n_near, words[r.top["at"]]) for r in variants.near_words(rows, exact).collect()}
    beside = {w: [v for v in words if near(w, v)] for w in words}
    assert got == {w: (len(b), min(b, key=lambda v: (-n[v], v))) for w, b in beside.items() if b}


def test_spelling_variants_of_very_long_words(spark):
    rng = random.Random(6)
    base = "".join(rng.choice("abcde") for _ in range(20_000))
    words = {base: 40, base[:-1]: 6, base + "x": 5, base[:9000] + "z" + base[9001:]: 8, "b" * 64: 50, "b" * 65: 9, "b" * 66: 9}
    docs = spark.createDataFrame([(k, " ".join([w] * n)) for k, (w, n) in enumerate(words.items())], "doc_id long, text string")
    got = variants.spelling_variants(docs).select("word", "n", "n_near", "form", "form_n", "root")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_variants(Counter(words))


def test_spelling_variants_of_no_words(spark, no_docs, odd_docs):
    assert variants.spelling_variants(no_docs).count() == 0
    got = variants.spelling_variants(odd_docs, noise=199).select("word", "n", "n_near", "form", "form_n", "root")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_variants(plain_words(rows_of(odd_docs)))


# ---------------------------------------------------------------- queries


def test_queries(spark):
    sf = "/root/testdata/sf0.001"
    rows = rows_of(common.read(spark, sf, "documents"))
    check_tokens([tuple(r) for r in queries.op12_token_files(spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect()], plain_tokens(rows))
    got = queries.op13_spelling_variants(spark, sf).select("word", "n", "n_near", "form", "form_n", "root").collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_variants(plain_words(rows))
    few = [r for r in rows if len(r[1] or "") < 3000]
    docs = spark.createDataFrame(few, "doc_id long, text string")
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = alignment.alignment(docs, BYTE, PIECE, digest=True).select(*names).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(plain_alignment(few), key=repr)
    assert queries.op11_alignment(spark, sf).select(*names).count() == len(rows)
    assert posixpath.basename(BYTE) == "byte_bpe_50k.json"
