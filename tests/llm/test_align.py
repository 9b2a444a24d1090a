"""Alignment against whole-text encoding and a walk along the bytes."""

import collections
import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from quillspark.llm import align
from quillspark.llm.tokens import default_tokenizer

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"
ODD = [
    None, "", " ", "  ", "\n", "a", " a", "a ", "a\n", "\na", "\n\na b", "tabs\there and  two   spaces", "line\nends\nin between\n\nblank", "end \n of", "<|endoftext|> <s> </s> <unk> <0x0A>",
    "a<|endoftext|>b", "low ▁ line ▁x", "é漢字😀 ñandú Straße", "x y  z", "\x00 nul\x00", "a\r\nb;\r\nc", "12345 67,890.12", "word " * 700, "no" * 5000, "don't won't I'll", "́ combining é", "🇩🇪👨‍👩‍👧 ok",
]


class Plain:
    """Both tokenizers on whole texts, as the contract says."""

    def __init__(self):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(default_tokenizer())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=align.piece_model())
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.letters = {chr(x): x for x in own}
        k = 0
        for x in range(256):
            if x not in own:
                self.letters[chr(256 + k)] = x
                k += 1

    def tokens(self, text):
        """([(id, bytes)] of A, of B), or two empty lists."""
        if not text:
            return [], []
        found = self.a.encode(" " + text, add_special_tokens=False)
        a = [(i, bytes(self.letters[c] for c in t)) for i, t in zip(found.ids, found.tokens, strict=True)]
        b = []
        for i in self.b.encode(text):
            p = self.b.id_to_piece(i)
            b.append((i, bytes([int(p[3:5], 16)]) if len(p) == 6 and p[:3] == "<0x" else p.replace("▁", " ").encode()))
        want = (" " + text).encode()
        return (a, b) if b"".join(x for _, x in a) == want == b"".join(x for _, x in b) else ([], [])

    def ends(self, tokens):
        at, out = 0, {}
        for k, (_, x) in enumerate(tokens):
            at += len(x)
            out[at] = k
        return out

    def document(self, text):
        a, b = self.tokens(text)
        ends_a, ends_b = self.ends(a), self.ends(b)
        cuts = sorted(set(ends_a) & set(ends_b))
        groups, last = [], (0, 0)
        for c in cuts:
            now = (ends_a[c] + 1, ends_b[c] + 1)
            groups.append(",".join(str(i) for i, _ in a[last[0] : now[0]]) + "|" + ",".join(str(i) for i, _ in b[last[1] : now[1]]))
            last = now
        links = [(a[ends_a[c]][0], b[ends_b[c]][0]) for c in cuts]
        overlaps = len(set(ends_a) | set(ends_b))
        return (len(a), len(b), len(groups), len(links), overlaps, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""), links


def expected(texts):
    plain = Plain()
    found = [plain.document(t) for t in texts]
    counts = collections.Counter(x for _, links in found for x in links)
    best = collections.defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [numbers + (sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links)) for numbers, links in found]


def run(spark, texts, **more):
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA).withColumn("links", F.lit("x")).withColumn("n_a", F.lit(-1)).repartition(5)
    rows = align.linked(df, default_tokenizer(), align.piece_model(), **more).orderBy("doc_id").collect()
    return [tuple(r[c] for c in (*align.NUMBERS, "groups_sha256", "n_best", "count_sum")) for r in rows]


def noise(seed=3, n=150):
    rng = random.Random(seed)
    pool = ["the", "token", "Straße", "naïve", "x", "\n", "\n\n", "  ", "\t", ".", ",\n", "12", "<|endoftext|>", "é", "▁", "\r\n", " ", "😀", "it's", "HTTPServer", "ſ"]
    return ["".join(rng.choice([*pool, " ", " ", " "]) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_equal_to_whole_texts(spark):
    texts = ODD + noise() + ODD[6:9]
    assert run(spark, texts) == expected(texts)


@pytest.mark.parametrize("at_once", [7, 60])
def test_slices_of_the_pair_table_add_up(spark, at_once):
    texts = ODD + noise(4, 12)
    assert run(spark, texts, pairs_at_once=at_once) == expected(texts)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_query_on_the_smallest_tables(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = align.op13_alignment(spark, SF).orderBy("doc_id").collect()
    assert [r.doc_id for r in got] == [r.doc_id for r in rows]
    assert [tuple(r[c] for c in (*align.NUMBERS, "groups_sha256", "n_best", "count_sum")) for r in got] == expected([r.text for r in rows])


def test_null_and_repeated_ids_and_empty_tables(spark):
    rows = [(None, "one two"), (None, "one two"), (5, None), (5, "two")]
    got = align.linked(spark.createDataFrame(rows, SCHEMA), default_tokenizer(), align.piece_model()).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.n_links > 0) for r in got) == [(False, 5, False), (False, 5, True), (True, None, True), (True, None, True)]
    assert align.linked(spark.createDataFrame([], SCHEMA), default_tokenizer(), align.piece_model()).collect() == []
    assert align.linked(spark.createDataFrame([(1, "")], SCHEMA), default_tokenizer(), align.piece_model()).first().groups_sha256 == ""


def test_a_vocabulary_that_joins_words_is_not_cut():
    """Where B has pieces across spaces, texts are encoded whole."""
    a, b = align.byte_level(default_tokenizer()), align.sentence_pieces(align.piece_model())
    whole = align.Aligner(a, align.Side(b.encode, b.tokens.to_pylist(), True))
    import pyarrow as pa

    texts = pa.array(noise(5, 30))
    one, other = align.Aligner(a, b)(texts), whole(texts)
    assert all((one[0][c] == other[0][c]).all() for c in one[0]) and [bytes(x) for x in one[1]] == [bytes(x) for x in other[1]]
