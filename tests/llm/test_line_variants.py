"""Keys of lines that lack a word: equal for equal words, and cheap for the longest lines."""

import tracemalloc

import pyarrow as pa

from runlens.llm import line_dedup


def emitted(*lines):
    """Emitted (no, variant, at) of a batch of lines."""
    batch = pa.RecordBatch.from_pydict(
        {"doc": [1] * len(lines), "key": [b"k"] * len(lines), "no": [*range(len(lines))],
         "words": [line.encode() for line in lines]},
        schema=pa.schema(line_dedup._WORDS_FIELDS))
    found = [row for out in line_dedup._emit([batch]) for row in out.to_pylist()]
    assert all(row["doc"] == 1 and row["key"] == b"k" for row in found)
    return [(row["no"], row["variant"], row["at"]) for row in found]


def test_keys_are_equal_where_words_are():
    lines = ["a b c d e f g h", "a b c d e f g h i", "a b c x d e f g h", "b a c d e f g h",
             "a a a a b b b b", "b b b b a a a a", "a", "a a", "h g f e d c b a", ""]
    words = {}
    for no, line in enumerate(lines):
        own = line.split()
        words[no, -1] = own
        words |= {(no, at): own[:at] + own[at + 1:] for at in range(len(own))}
    found = emitted(*lines)
    assert sorted((no, at) for no, _, at in found) == sorted(words)
    keys = {(no, at): key for no, key, at in found}
    for a in words:
        for b in words:
            assert (keys[a] == keys[b]) == (words[a] == words[b])


def test_memory_follows_the_words_of_a_line():
    line = " ".join(f"w{i}" for i in range(4000))
    tracemalloc.start()
    assert len(emitted(line)) == 4001
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 16 << 20


def test_long_lines_a_word_apart_are_found(spark):
    words = [f"w{i}" for i in range(12_000)]
    docs = spark.createDataFrame(
        [(1, " ".join(words)), (2, " ".join([*words[:7000], "x", *words[7001:]])),
         (3, " ".join([*words[:9000], *words[9001:]])), (4, " ".join([*words[:5], "y", *words[5:]])),
         (5, " ".join([*words[:5], "y", *words[5:7000], "x", *words[7001:-1]])),
         (6, " ".join(["u", "v", *words[2:]]))], "doc_id long, text string")
    kept = {row.doc_id for row in line_dedup.dedup_lines(docs).collect() if row.text}
    assert kept == {1, 5, 6}
