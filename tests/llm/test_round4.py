"""Results and steps that earlier rounds lost."""

import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from colophon.llm import idcoder, langid, tokenfiles, tokens


# 7 token files
def test_coder_predicts_from_the_ids_before():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 5000, (4000, 5))
    ids = words[rng.integers(0, len(words), 40_000)].ravel()
    data = idcoder.encode_block(ids, 5000)
    assert np.array_equal(idcoder.decode_block(data), ids)
    # most ids of a word follow from the two before
    assert len(data) < 0.8 * len(idcoder.encode_block(rng.permutation(ids), 5000))


def test_coder_adds_what_the_orders_give_an_id():
    model = idcoder._Model(300, 1)
    for k in [5, 9, 200, 5, 9, 5, 9, 200, 5, 9, 7, 5, 9]:
        model.predict()
        model.learn(np.array([k]))
    model.predict()
    assert {int(model.guess1[0]), int(model.guess2[0])} - {0}
    parts = [model.interval(np.array([k])) for k in range(300)]
    begins, sizes = np.array([b[0] for b, _ in parts]), np.array([s[0] for _, s in parts])
    assert sizes.min() > 0 and sizes.sum() == idcoder.TOTAL
    assert np.array_equal(begins, np.cumsum(sizes) - sizes)
    assert [int(model.id_at(np.array([t]))[0]) for t in begins] == list(range(300))
    assert [int(model.id_at(np.array([t]))[0]) for t in begins + sizes - 1] == list(range(300))


def test_coder_takes_few_steps_a_block(monkeypatch):
    steps = []
    predict = idcoder._Model.predict
    monkeypatch.setattr(idcoder._Model, "predict", lambda model: steps.append(len(model.last)) or predict(model))
    ids = np.random.default_rng(2).integers(0, 900, tokenfiles.BLOCK_IDS) ** 2 // 900
    assert np.array_equal(idcoder.decode_block(idcoder.encode_block(ids, 900)), ids)
    # each step costs its calls, however few ids it codes
    assert sum(steps) == 2 * len(ids) == 8192 * len(steps)


def test_sums_beyond_a_digit_are_carried():
    word = idcoder.WORD
    assert idcoder._carried(np.array([7, word, word, word + 6, 0, 3 * word], np.uint32)).tolist() == [8, 0, 0, 5, 2, word - 2]
    # one id takes nearly the whole range, at its upper end: lanes wait long for a word
    ids = np.full(30_000, 49_999)
    ids[::997] = 0
    data = idcoder.encode_block(ids, 50_000)
    assert np.array_equal(idcoder.decode_block(data), ids)


def test_words_of_several_batches_are_encoded_once(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["one two  two", "", None, "日本 x <|endoftext|> y", "one two thirteen", "it's one\nélan", "one two"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    met = []
    word_ids = tokens.Encoder._word_ids
    monkeypatch.setattr(tokens.Encoder, "_word_ids", lambda self, words: met.extend(words.to_pylist()) or word_ids(self, words))
    found = [ids for _, some in tokens.encoded([batch], path, 7, most=24, together=4) for ids in some]
    plain = Tokenizer.from_file(path)
    assert [np.frombuffer(x, "<u4").tolist() for x in found] == [plain.encode(t or "", add_special_tokens=False).ids + [7] for t in texts]
    # batches of 24 bytes, four at a time
    assert met.count(b"one") == 1 and met.count(b" two") == 1


# pipeline, language_id
def test_words_take_little_memory_a_character():
    text = "some words of a language " * 40_000
    langid.characters()
    tracemalloc.start()
    found = langid._words([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found["start"]) == 200_000
    assert peak < 32 * len(text)


def test_trigram_buckets_and_scores_do_not_depend_on_pieces(monkeypatch):
    texts = ["", "one two", "x" * 300, "slovo über ß 漢字 " * 30, "a b c " * 50]
    model = langid.Model(["a", "b"], np.random.default_rng(1).random((langid.BUCKETS, 2)).astype(np.float32), np.ones((len(langid.SCRIPTS) + 1, 2), bool), 1.0)
    whole = langid._label(texts, model)
    monkeypatch.setattr(langid, "PIECE", 7)
    cut = langid._label(texts, model)
    assert all(np.array_equal(whole[k], cut[k]) for k in whole)
