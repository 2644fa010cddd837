"""Common words are those of all documents, not of some."""

from __future__ import annotations

import hashlib

from quillbook.llm import quality


def test_common_words_are_counted_in_all_documents(spark):
    words = list("abcdefghijklm")
    texts = [" ".join([*words, *[f"{i}x{k}" for k in range(50)]]) for i in range(5000)]
    # "a" lacks two documents, all others lack one; a sample of 2000 by hash would not see where "a" lacks
    seen = [int(hashlib.md5(t.encode()).hexdigest()[:8], 16) < 4294967296 * 2000 / 5000 for t in texts]
    some, rest = [i for i, s in enumerate(seen) if s], [i for i, s in enumerate(seen) if not s]
    for i in rest[:2]:
        texts[i] = texts[i][2:]
    for w, i in zip(words[1:], some[:12], strict=True):
        texts[i] = texts[i].replace(f"{w} ", "", 1)
    docs = spark.createDataFrame([(t, "en") for t in texts], "text string, lang string")
    assert quality.learned_words(docs) == words[1:]
