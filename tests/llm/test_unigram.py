"""Token counts against the tokenizers library's unigram model."""

import random
from itertools import product

from tokenizers import Tokenizer, models

from skyledger.llm import unigram as U
from skyledger.llm.queries import QUERIES, vocabulary

PATH = vocabulary("piece_bpe_32k.model")


def library():
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    n = sp.vocab_size()
    vocab = [(sp.id_to_piece(i), float(sp.get_score(i)) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)) else -1e9)
             for i in range(n)]
    return Tokenizer(models.Unigram(vocab, 0, True))


def plain(tok, text):
    return len(tok.encode(U.MARK + text.replace(" ", U.MARK), add_special_tokens=False).ids) if text else 0


def test_query_matches_the_library(spark, sf):
    tok = library()
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: (r["n_tokens"], r["n_chars"]) for r in QUERIES["op1_token_counts"](spark, sf).collect()}
    assert got == {i: (plain(tok, t), len(t)) for i, t in docs.items()}


def test_odd_texts():
    tok, counter = library(), U.load(PATH)
    rng = random.Random(2)
    letters = "the of ain  \n\té漢字😀梦aaabb'.,▁ "
    for _ in range(1500):
        text = "".join(rng.choices(letters, k=rng.randint(0, 60)))
        assert counter.count(text) == plain(tok, text), text


def test_ties_go_the_tokenizers_way():
    vocab = [("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("aab", -3.0), ("▁", -1.0), ("▁a", -2.0), ("abab", -4.0)]
    counter = U.UnigramCounter(vocab, byte_fallback=False)
    tok = Tokenizer(models.Unigram([("<unk>", -5.0)] + vocab, 0, False))
    for n in range(1, 9):
        for letters in product("ab", repeat=n):
            text = "".join(letters)
            assert counter.count(text) == plain(tok, text), text


def test_edges_of_the_table(spark):
    rows = [(1, None, 5), (2, "", 6), (3, "a b", 7), (3, "a b", 7), (None, "a b", 8), (4, "x" * 50_000, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = [(r["doc_id"], r["n_tokens"]) for r in U.token_counts(df, PATH).collect()]
    two = U.load(PATH).count("a b")
    assert sorted(got[:5], key=str) == sorted([(1, 0), (2, 0), (3, two), (3, two), (None, two)], key=str)
    assert got[5][1] == U.load(PATH).count("x" * 50_000) > 0
    assert U.token_counts(df.limit(0), PATH).collect() == []
