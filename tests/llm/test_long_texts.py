"""Very long texts of numbers and very long words, in about linear time."""

import random
import time

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lectern.llm import bpe, minhash, pii

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_long_list_of_numbers(spark):
    """4 MB of phone and card numbers with letters of two bytes between them: base and added spans as in its parts."""
    rng = random.Random(3)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    lines = [f"é {number(16)} ß 0{number(3)} {number(3)} {number(4)} +49 {number(3)} {number(7)} a.b (at) mail.org\n" for _ in range(400)]
    copies = 4_000_000 // sum(len(x.encode()) for x in lines)
    model = pii.learn()
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lines)] + [(-1, "".join(lines) * copies)], "doc_id long, text string")
    one = {r["doc_id"]: r for r in pii.find(df.where("doc_id >= 0"), model).collect()}
    began = time.time()
    whole = pii.find(df.where("doc_id = -1").coalesce(1), model).collect()[0]
    took = time.time() - began
    shifted, at = [], 0
    for k, line in enumerate(lines):
        for span in filter(None, one[k]["spans"].split(",")):
            kind, a, b = span.split(":")
            shifted.append(f"{kind}:{int(a) + at}:{int(b) + at}")
        at += len(line)
    assert whole["spans"].split(",")[: len(shifted)] == shifted and len(shifted) > 1000
    assert whole["n_added"] == copies * sum(r["n_added"] for r in one.values()) > 0
    assert took < 60


def test_long_words():
    """Random letters in one word: the library's tokens, in a time that grows about as the word does."""
    rng = random.Random(1)
    library, own = Tokenizer.from_file(PATH), bpe.WordBpe(PATH)
    times = []
    for n in (300, 20_000, 200_000):
        word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
        began = time.time()
        (ids, _), = own.encode([word])
        times.append(time.time() - began)
        assert ids == b"".join(t.to_bytes(4, "little") for t in library.encode(word, add_special_tokens=False).ids)
    assert times[2] < max(5.0, 40 * times[1])


def test_long_words_beside_short_ones(spark):
    words = ["zqxj" * 100, "hello", "zq" * 40 + "e" * 300, "I'LL", "ab" * 129]
    df = spark.createDataFrame([(1, " ".join(words)), (2, "x" * 257), (3, "x" * 256), (4, None)], "doc_id long, text string")
    library = Tokenizer.from_file(PATH)
    got = {r["doc_id"]: r["ids"] for r in bpe.encode(df.withColumn("ids", F.lit("?")), PATH).collect()}
    assert got == {r["doc_id"]: library.encode(r["text"] or "", add_special_tokens=False).ids for r in df.collect()}


def test_words_of_like_structure(spark):
    """Words in the Thue-Morse order and its complement, by which polynomials modulo a power of two collide, are not the same word."""
    order = [bin(i).count("1") % 2 for i in range(4096)]
    one, other = ("".join("ab"[x ^ flip] for x in order) for flip in (0, 1))
    rows = [(1, f"{one} and some words"), (2, f"{other} and some words"), (3, f"{one} and some words"), (4, "ab ba ab bb"), (5, "ba ab ba ab"), (6, one), (7, other)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df, k=3, percent=85).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7}
