"""Chat formatting, vector codes and phrases against brute force, and their defined results for odd rows."""

import hashlib
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from marketloom.llm import chat_format, phrases, vector_codes

TURNS = "conv_id bigint, turn bigint, role string, text string"


def by_hand(rows):
    """conv_id -> (turns, digest, learned characters, their digest)."""
    held = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0)):
        held.setdefault(conv, []).append((role or "", text or ""))
    out = {}
    for conv, turns in held.items():
        learned = "".join(t for r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    return out


def digests(frame, **columns):
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat_format.read_back(chat_format.formatted(frame, **columns)).collect()}


def test_chat_of_odd_texts(spark):
    rng = random.Random(5)
    bits = ["\\", "<", "|", ">", "<turn>", "</turn>", "\n", "<text>", "### Assistant:", "### ", "é", "😀", "a", "</", "<|image_1|>", "|>", "", "$0", "\0"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "<turn>", "a\nb\\", None]), "".join(rng.choices(bits, k=rng.randrange(9)))) for c in range(60) for t in range(1 + c % 7)]
    rows += [(1000, 0, "user", None), (1000, 1, "assistant", None), (1001, 3, None, "late"), (1001, None, "assistant", "first"), (None, 0, "user", "x"), (None, 1, "assistant", "y"), (2 ** 63 - 2, 0, "user", "far"), (2 ** 63 - 1, 0, "user", "farther")]
    rows += [(1002, t, "assistant", "long é " * 100_000) for t in range(5)]
    frame = spark.createDataFrame(rows, TURNS).selectExpr("*", "'x' AS segment", "'x' AS flat", "'x' AS formatted", "1 AS part")
    assert digests(frame) == by_hand(rows)
    formats = chat_format.formatted(frame).collect()
    marks = chat_format.PLAIN
    for r in formats:
        assert r["formatted"].count(marks.open) == r["formatted"].count(marks.text) == r["formatted"].count(marks.close) == r["n_turns"]
        assert not any(g in r["formatted"] for g in (*marks.guarded, marks.placeholder))
    long = sorted((r["part"], r["start"], len(r["formatted"]), r["last"]) for r in formats if r["conv_id"] == 1002)
    assert len(long) > 1 and [x[3] for x in long] == [False] * (len(long) - 1) + [True]
    assert all(a[1] + a[2] == b[1] for a, b in zip(long, long[1:]))
    assert chat_format.read_back(chat_format.formatted(frame.limit(0))).count() == 0


def test_chat_ties_and_repeats(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, "assistant", "z")]
    got = chat_format.formatted(spark.createDataFrame(rows, TURNS)).collect()
    assert [r["formatted"] for r in got] == ["<turn>user<text>a</turn>\n<turn>user<text>a</turn>\n<turn>user<text>b</turn>\n<turn>assistant<text>z</turn>\n"]
    assert [got[0]["formatted"][s["start"]:s["end"]] for s in got[0]["loss_spans"]] == ["z"]


def test_chat_parts_become_ordered_placeholders(spark):
    part = lambda kind, text=None, ref=None, width=None, height=None, seconds=None, pages=None: (kind, text, ref, width, height, seconds, pages)
    content = [part("text", "see <|image_2|> "), part("image", ref="s3://a.png", width=30, height=14), part("audio", ref="b.wav", seconds=2.01), part("text", "and"),
               part("document", ref="c.pdf", pages=3), part("image", ref=None), part("video", ref="d"), part(None, "end")]
    frame = spark.createDataFrame([(1, 0, "user", content), (1, 1, "assistant", None), (1, 2, "assistant", [])], "conv_id bigint, turn bigint, role string, parts " + chat_format.CONTENT)
    row = chat_format.formatted(frame, content="parts").collect()[0]
    assert row["formatted"] == ("<turn>user<text>see <\\|image_2|\\> <|image_2|><|audio_3|>and<|document_5|><|image_6|><|other_7|>end</turn>\n"
                                + "<turn>assistant<text></turn>\n" * 2)
    assert [tuple(a) for a in row["attachments"]] == [
        (1, 2, "image", "s3://a.png", 3), (1, 3, "audio", "b.wav", 51), (1, 5, "document", "c.pdf", 1536), (1, 6, "image", None, 1), (1, 7, "other", "d", 1)]
    assert row["expanded_tokens"] == 3 + 51 + 1536 + 1 + 1
    turns = list(chat_format.turns_in(row["formatted"]))
    assert turns[0] == ("user", [("text", "see <|image_2|> "), ("image", "2"), ("audio", "3"), ("text", "and"), ("document", "5"), ("image", "6"), ("other", "7"), ("text", "end")])
    assert turns[1:] == [("assistant", [])] * 2


def test_chat_templates_need_safe_marks():
    for bad in ("<", "\\<a>"):
        with pytest.raises(ValueError):
            chat_format.Template(open=bad)


def codes_by_hand(rows, rounds=4):
    """vec_id, label, vector -> the rows of the operator, in whole numbers of Python."""
    floor = lambda x: Fraction(x) * 1024 // 1
    whole = [(i, label, [int(floor(float(np.float32(x)))) for x in v]) for i, label, v in rows]
    whole.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    size = len(whole[0][2]) // 4
    cut = [[v[p * size:(p + 1) * size] for p in range(4)] for _, _, v in whole]
    books = [[parts[p] for parts in cut[:256]] for p in range(4)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(4):
            groups = {}
            for parts in cut:
                groups.setdefault(near(parts[p], books[p])[1], []).append(parts[p])
            books[p] = [[sum(c) // len(groups[k]) for c in zip(*groups[k])] if k in groups else e for k, e in enumerate(books[p])]
    said = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    out, errors = [], Counter()
    for (i, label, _), parts in zip(whole, cut):
        best = [near(parts[p], books[p]) for p in range(4)]
        out.append((i, label, bytes(k for _, k in best).hex(), sum(d for d, _ in best)))
        errors[label] += out[-1][3]
    return sorted(((i, code, error, errors[label], said) for i, label, code, error in out), key=str)


def got_codes(frame):
    return sorted(((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in vector_codes.coded(frame).collect()), key=str)


VECTORS = "vec_id bigint, embedding array<float>, label int"


def test_codes_of_odd_vectors(spark):
    rng = np.random.default_rng(4)
    good = [(int(i), [float(np.float32(x)) for x in v], int(i) % 3 if i % 5 else None) for i, v in enumerate(rng.normal(size=(300, 8)))]
    good += [(7, good[7][1], 1), (7, good[9][1], None), (None, good[3][1], 2), (400, [0.0] * 8, 2), (401, [-0.0005] * 8, None), (402, [1e6] * 8, 1), (403, [-9e5] * 8, 1)]
    bad = [(500, None, 1), (501, [], 1), (502, [1.0, None] * 4, 1), (503, [float("nan")] * 8, 1), (504, [float("inf")] + [0.0] * 7, 1), (505, [1.0] * 4, 1), (506, [1.0] * 7, 1)]
    frame = spark.createDataFrame(good + bad, VECTORS).selectExpr("*", "'x' AS x", "'x' AS code", "'x' AS error", "'x' AS entry")
    assert got_codes(frame) == codes_by_hand([(i, label, v) for i, v, label in good])
    few = spark.createDataFrame(good[:9], VECTORS)
    assert got_codes(few) == codes_by_hand([(i, label, v) for i, v, label in good[:9]])
    assert vector_codes.coded(frame.limit(0)).count() == 0 and vector_codes.coded(spark.createDataFrame(bad[:5], VECTORS)).count() == 0


def test_codes_of_huge_components(spark):
    rows = [(i, [3.0e38 * (-1) ** i, float(i), 1.0, -1.0], 0) for i in range(4)]
    got = vector_codes.coded(spark.createDataFrame(rows, VECTORS)).collect()
    assert sorted(r["vec_id"] for r in got) == [0, 1, 2, 3] and all(r["error"] == 0 for r in got)


def test_codes_lead_back_to_vectors(spark):
    rows = [(i, [float(i % 3), 1.0, float(i % 2), 0.25], 0) for i in range(12)]
    frame = spark.createDataFrame(rows, VECTORS)
    books = vector_codes.first_books(vector_codes.kept(frame))
    back = {r["vec_id"]: r["v"] for r in vector_codes.decoded(vector_codes.assigned(vector_codes.kept(frame), books), books).collect()}
    assert back == {i: v for i, v, _ in rows}


def test_cells_give_the_nearest_entry_with_few_evaluated():
    rng = np.random.default_rng(8)
    book = rng.integers(-600, 600, (256, 16))
    book[9] = book[4]  # a tie
    for spread, shared in ((2, True), (400, False)):
        parts = np.repeat(book, 40, axis=0) + rng.integers(-spread, spread + 1, (256 * 40, 16)) * (rng.random((256 * 40, 1)) < 0.5)
        cells = vector_codes.Cells(book)
        for low in range(0, len(parts), 4096):
            some = parts[low:low + 4096]
            found, far = cells.nearest(some)
            apart = ((some[:, None] - book[None]) ** 2).sum(axis=2)
            assert (found == apart.argmin(axis=1)).all() and (far == apart.min(axis=1)).all()
        assert (cells.exact < cells.asked / 2) == shared
    far_out = np.array([[10 ** 12] * 16, [-3] * 16], dtype=object)
    found, far = vector_codes.Cells(book).nearest(far_out)
    for row, k, d in zip(far_out, found, far):
        all_far = [sum((int(a) - int(b)) ** 2 for a, b in zip(row, e)) for e in book]
        assert d == min(all_far) and k == all_far.index(min(all_far))


def phrases_by_hand(rows, least, best):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for n in range(1, 6):
                for i in range(len(words) - n + 1):
                    counts[lang, tuple(words[i:i + n])] += 1
    candidates = {k: f for k, f in counts.items() if len(k[1]) >= 2 and f >= least}
    inside = {(lang, w[i:j]) for (lang, w), f in candidates.items() for i in range(len(w)) for j in range(i + 2, len(w) + 1) if j - i < len(w) and f >= counts[lang, w[i:j]]}
    out = {}
    for (lang, w), a in candidates.items():
        if (lang, w) in inside:
            continue
        n = totals[lang]
        score, _, l, r = min((1000 * a * n // (counts[lang, w[:k]] * counts[lang, w[k:]]), k, counts[lang, w[:k]], counts[lang, w[k:]]) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), " ".join(w), l, r, n))
    return sorted((lang, i, p, -a, l, r, n, -s) for lang, some in out.items() for i, (s, a, _, p, l, r, n) in enumerate(sorted(some)[:best], 1))


DOCS = "doc_id bigint, text string, lang string"


def test_phrases_of_odd_texts(spark):
    rng = random.Random(2)
    words = ["New", "york", "city", "a", "b", "é", " x", "don't", "New York", "über", "\0"]
    texts = ["".join(w + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "\r", "\x0b"]) for w in rng.choices(words, k=rng.randrange(40))) for _ in range(120)]
    rows = [(t, rng.choice(["en", "de", None, "und", ""])) for t in texts] + [(None, "en"), ("", "fr"), (" .,; ", "fr"), ("once only here", "es")]
    rows += [("la la la la la la", "it")] * 2 + [("long winded text " * 20_000, "xx")]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], DOCS).selectExpr("*", "'x' AS phrase", "1 AS n", "1 AS f", "'x' AS word", "'x' AS times")
    for least, best in ((3, 2000), (2, 5)):
        got = sorted(tuple(r) for r in phrases.collocations(frame, least=least, best=best).collect())
        assert got == phrases_by_hand(rows, least, best)
    assert phrases.collocations(frame.limit(0)).count() == 0
    assert phrases.collocations(frame, least=10 ** 9).count() == 0


def test_phrases_in_cut_texts():
    text = "one two, three four five six. " * 30 + "x" * 200 + " seven eight nine " * 5
    whole = Counter()
    cut = Counter()
    for most, counter in ((1 << 20, whole), (64, cut)):
        for blobs, langs, own in phrases.cut_texts([text, "", "short one two"], ["en", "en", "de"], most):
            held = phrases.grams(blobs, langs, own)
            for n in range(1, 6):
                gram, ok = held.hashes(n)
                counter.update((n, int(g)) for g in gram[ok & held.own])
    assert whole == cut and len(whole) > 20


def test_equal_fingerprints_are_told_apart():
    held = phrases.grams([b"aa bb aa bb cc dd aa  bb"], ["en"], [99])
    at = np.array([0, 2, 4, 6])
    found = list(phrases._told_apart(phrases.word_numbers(held, np.ones(8, dtype=bool)), 2, np.zeros(8, dtype=np.uint64), at))
    assert sorted(found) == [(0, 3), (4, 1)]
    held.word[:] = 7  # all words with one hash
    numbers = phrases.word_numbers(held, np.arange(8) != 5).tolist()
    assert numbers[5] == -1 and [numbers.index(x) for x in numbers] == [0, 1, 0, 1, 4, 5, 0, 1]


def test_filters_hold_what_was_put_in(spark):
    some = [random.Random(i).getrandbits(64) - (1 << 63) for i in range(500)]
    held = phrases.filter_of(spark.createDataFrame([(x,) for x in some], "fingerprint bigint"))
    assert held.holds(np.array(some, dtype=np.int64).view(np.uint64)).all()
    others = np.random.default_rng(1).integers(1 << 63, size=2000, dtype=np.uint64)
    assert held.holds(others).sum() < 20


def test_large_scores_are_exact(spark):
    """Products beyond 64 bits: the same arithmetic as in the operator, on counts of a very large corpus."""
    a, n, l, r = 10 ** 12, 16 * 10 ** 12, 3 * 10 ** 12 + 1, 2 * 10 ** 12 + 3
    row = spark.sql(f"SELECT (1000BD * CAST({a} AS DECIMAL(38,0)) * CAST({n} AS DECIMAL(38,0))) div (CAST({l} AS DECIMAL(38,0)) * CAST({r} AS DECIMAL(38,0))) AS s").first()
    assert row["s"] == 1000 * a * n // (l * r)
