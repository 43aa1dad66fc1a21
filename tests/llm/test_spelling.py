import random
import re
from collections import Counter
from itertools import combinations
from zlib import crc32

import pytest

from strandline.llm import queries, spelling


def one_edit(a, b):
    """Whether exactly one inserted, deleted or replaced code point makes ``a`` into ``b``."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain(rows):
    """The definition, word by word; near words over all words that share a form with a letter left out."""
    counted = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = crc32(f"{doc_id}:{run}".encode())
            counted[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: n for w, n in counted.items() if len(w) >= 5 and n >= 3}
    near, by = {w: set() for w in words}, {}
    for w in words:
        for s in {w, *(w[:k] + w[k + 1 :] for k in range(len(w)))}:
            by.setdefault(s, []).append(w)
    for group in by.values():
        for a, b in combinations(group, 2):
            if one_edit(a, b):
                near[a].add(b)
                near[b].add(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)


@pytest.mark.parametrize("cells", [spelling.TRIE_CELLS, 600])
def test_the_query_is_the_definition(spark, small, monkeypatch, cells):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    if cells == 600:  # many small tries, several passes
        docs = docs[:12]
        monkeypatch.setattr(spelling, "BROADCAST", 2000)
        monkeypatch.setattr(spelling, "TRIE_CELLS", cells)
        df = spelling.variant_groups(spark.createDataFrame(docs, "doc_id long, text string"))
    else:
        df = queries.op12_spelling_variants(spark, small)
    want = plain(docs)
    assert rows_of(df) == want and any(w[1] for w in want)


def test_odd_rows(spark):
    texts = [(1, "Straße straße STRASSE, Ünited ünited"), (2, None), (None, "colour COLOUR colour"), (3, ""), (4, "aaaaaaaa " * 5), (4, "aaaaaaaa aaaaaaa aaaaaaa aaaaaaa"), (5, "×÷×÷× " * 4 + "colour " * 9 + "color " * 3 + "z" * 3000 + " " + "z" * 3000 + "x" + "z" * 3000), (6, ("z" * 3001 + " ") * 3 + ("z" * 3000 + " ") * 4)]
    df = spark.createDataFrame([(i, t, "n") for i, t in texts], "doc_id long, text string, word string")
    assert rows_of(spelling.variant_groups(df)) == plain([("" if i is None else i, t) for i, t in texts])
    assert spelling.variant_groups(df.limit(0)).collect() == []


@pytest.mark.parametrize("letters", ["ab", "abcé", "abcdefghijklmnopqrstuvwxyzàÿ"])
def test_neighbours_of_random_words(letters):
    draw = random.Random(letters)
    words = sorted({"".join(draw.choice(letters) for _ in range(draw.choice([1, 2, 3, 4, 5, 6, 9]))) for _ in range(700)})
    counts = {w: draw.randrange(1, 9) for w in words}
    cut = len(words) // 3
    parts = [words[:cut], words[cut:]]
    blobs = [spelling.plant([w.encode("latin-1") for w in part], [counts[w] for w in part]) for part in parts]
    asked = words + ["zzzzz", "ab", "b"]
    near, most, best = spelling.look_up([w.encode("latin-1") for w in asked], blobs)
    for w, n, top, form in zip(asked, near, most, best):
        own = [o for o in words if one_edit(w, o)]
        assert n == len(own)
        if own:
            want = min(own, key=lambda o: (-counts[o], o))
            assert (top, form.decode("latin-1")) == (counts[want], want)


def test_stretches_of_a_text_are_its_runs(monkeypatch):
    text = "Abcdé fghijk, lmnop " * 50
    whole = spelling.variants("7", text)
    monkeypatch.setattr(spelling, "TEXT_STRETCH", 3)
    assert spelling.variants("7", text) == whole
