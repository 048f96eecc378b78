"""Byte-level helpers and operators on plain Python objects, against brute force."""

import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import bpe, langid, linear, packing, pii, quality, sharding, shingles, textcore, tokenstore, toxicity

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbß é\n\t.,'1 ", max_size=40)), max_size=8)


def array(texts):
    return pa.array(texts, pa.large_string())


@settings(max_examples=60, deadline=None)
@given(TEXTS, st.integers(1, 30))
def test_words_and_equal_hashes(texts, limit):
    seen = {}
    got = []
    for c in textcore.chunks(array(texts), limit):
        w = c.words(textcore.NONSPACE)
        for d in range(c.n):
            mine = [bytes(c.buf[w.starts[i] : w.ends[i]]).decode() for i in range(w.first[d], w.first[d] + w.count[d])]
            got.append(mine)
            for i, word in zip(range(w.first[d], w.first[d] + w.count[d]), mine):
                assert seen.setdefault(word, w.hash[i]) == w.hash[i]
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    assert len(set(seen.values())) == len(seen)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_shingle_sets(texts):
    got = [n for _, _, _, counts in shingles.sets(array(texts)) for n in counts.tolist()]

    def want(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        return len({tuple(w[i : i + 5]) for i in range(len(w) - 4)}) if len(w) >= 5 else int(bool(w))

    assert got == [want(t) for t in texts]


ODD = ["", " ", "a  b", "a\n\nb", "a \n b\n", "\n\n  x", "x  y", "　", "it's 'twas\tTab\t\tq  ", "a <|endoftext|> b", "é ß 12,5 €  … z", "don't\r\nstop", None, "\x1c a", "a!!b,c.'s", "x" * 300]


def test_bpe_equals_the_library():
    e = bpe.Encoder(bpe.default_path(), slots=64)
    for _ in range(2):
        for text, ids in zip(ODD, e.encode(array(ODD))):
            assert ids.tolist() == e.tokenizer.encode(text or "", add_special_tokens=False).ids, text


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="ab'1,! \n\té ", max_size=30), max_size=4))
def test_bpe_on_any_text(texts):
    e = bpe.Encoder.shared(bpe.default_path())
    for text, ids in zip(texts, e.encode(array(texts))):
        assert ids.tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


@given(st.integers(1, 9000))
def test_cuts_cover_a_document(n):
    assert sum(packing.cuts(n)) == n and max(packing.cuts(n)) <= 2048


def test_packer_wastes_little():
    rng = np.random.default_rng(0)
    p, full, tokens = packing.Packer(), [], 0
    for n in rng.integers(1, 6000, 3000).tolist():
        tokens += n
        full += [b for x in packing.cuts(n) if (b := p.add(x, None))]
    full += p.rest()
    sizes = [sum(x for x, _ in b) for b in full]
    assert max(sizes) <= 2048 and sum(sizes) == tokens
    assert 2048 * len(sizes) <= 1.02 * tokens


def test_perfect_hash_is_minimal_and_turns_strangers_away():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.uint64))
    marks = (keys >> np.uint64(7)).astype(np.uint32)
    one = np.ones(len(keys), np.int64)
    data, n = tokenstore.Segment.dump(keys, marks, {"shard": one, "at": 10 * np.arange(len(keys)), "ids": one, "ordinal": np.arange(len(keys)), "count": one})
    touched = []
    s = tokenstore.Segment(lambda start, length: touched.append(length) or data[start : start + length])
    assert s.n == n == len(keys)
    who, runs = s.find(keys, marks)
    assert (runs["ordinal"] == who).all() and sorted(who.tolist()) == list(range(len(keys)))
    assert len(s.find(keys + np.uint64(1), marks ^ np.uint32(0xFFFF))[0]) == 0
    # a keyed access reads a few bytes and finds the same
    for i in range(0, 5000, 97):
        touched.clear()
        assert [r["at"] for r in s.get(int(keys[i]), int(marks[i]))] == [10 * i] and sum(touched) < 2000
        assert s.get(int(keys[i]), int(marks[i]) ^ 1) == []


def test_fisher_yates_is_a_permutation_by_seed():
    assert sorted(sharding.fisher_yates(100, "a").tolist()) == list(range(100))
    assert sharding.fisher_yates(100, "a").tolist() == sharding.fisher_yates(100, "a").tolist() != sharding.fisher_yates(100, "b").tolist()


@pytest.mark.parametrize(
    "text, kind, found",
    [
        ("mail joe [at] example [dot] com now", "email", "joe [at] example [dot] com"), ("joe at example dot com", "email", "joe at example dot com"),
        ("jое@ехаmple.com", "email", "jое@ехаmple.com"), ("+one two three four five six seven eight", "phone", "+one two three four five six seven eight"),
        ("ip 10 dot 2 dot 3 dot 4", "ip", "10 dot 2 dot 3 dot 4"), ("１0.２.3.4", "ip", "１0.２.3.4"), ("card 4539578763621486 x", "card", "4539578763621486"),
    ],
)
def test_disguised_identifiers(text, kind, found):
    assert [(k, text[s:e]) for k, s, e in pii.find(text)[1]] == [(kind, found)]


@pytest.mark.parametrize("text", ["", "meet at site.com at noon", "one two three go", "un deux", "four five six seven - nothing", "look at the dot on it", "999.1.1.1", "+12 34"])
def test_clean_texts_stay(text):
    assert pii.find(text) == ([], []) and pii.redact_text(text, pii.find(text)[1]) == text


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab@.-_ 1+", max_size=40))
def test_linear_email_search_equals_the_pattern(text):
    assert pii.detect(text)["email"] == [m.span() for m in EMAIL.finditer(text)]


def test_long_digit_runs_do_not_fail():
    assert pii.find("1" * 50000 + "." + "2" * 5000 + ".3.4")[0] == []


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_quality_measures(texts):
    for c in textcore.chunks(array(texts)):
        m = quality.measure(c, c.words(textcore.NONSPACE))
        for i, t in enumerate(texts[c.lo : c.hi]):
            w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
            n = Counter(zip(w, w[1:], w[2:]))
            covered = {k + j for k in range(len(w) - 2) if n[tuple(w[k : k + 3])] > 1 for j in range(3)}
            lines = [x for x in (t or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
            assert [m[k][i] for k in ("n_words", "word_chars", "n_dup_lines", "n_repeat_words")] == [len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(covered)]


def test_classifiers_learn_and_survive_one_class():
    good, bad = "the cat sat on the mat and it was fine ", "buy $$$ now!! click *** here "
    sample = [(good * (3 + i % 4), 1) for i in range(40)] + [(bad * (3 + i % 4), 0) for i in range(40)]
    score = lambda model, t: [model.score(c, c.words(textcore.NONSPACE))[0] for c in textcore.chunks(array([t]))][0]
    model = quality.QualityModel.fit(sample)
    assert score(model, good * 5) > 0.5 > score(model, bad * 5)
    assert score(quality.QualityModel.fit(sample[:10]), bad) > 0.5
    tox = toxicity.ToxicityModel.fit([(t, 1 - y) for t, y in sample])
    run = lambda m, t: [m.score(c)[0] for c in textcore.chunks(array([t]))][0]
    assert run(tox, bad) > 0.5 > run(tox, good) and 0 <= run(tox, "") <= 1
    assert run(toxicity.ToxicityModel.fit([]), "x") < 0.5


def test_language_backs_off_to_ngrams():
    m = langid.LanguageModel.fit([("thing nothing the something", "en"), ("schule schon die mensch", "de")])
    (c,) = langid._padded(array(["anything", "schwer", "thing schule thing", "qqqq", ""]))
    best, score = m.score(c)
    assert [m.langs[b] for b in best[:3]] == ["en", "de", "en"] and (score <= 1).all()


def test_platt_stays_finite():
    a, b = linear.fit_platt(np.array([-5.0, -4, 4, 5]), np.array([0.0, 0, 1, 1]))
    assert np.isfinite([a, b]).all() and a > 0


@pytest.mark.parametrize(
    "text, kind, part",
    [
        ("write to jоhn.smith@example.com now", "email", "jоhn.smith@example.com"), ("call +49 30 1234 567 eight nine please", "phone", "+49 30 1234 567 eight nine"),
        ("host 10.2.3.4５ is up", "ip", "10.2.3.4５"), ("mail john@mail.example dot com, thanks", "email", "john@mail.example dot com"),
        ("mail joe @ example.com, thanks", "email", "joe @ example.com"), ("mail joe@ example.com, thanks", "email", "joe@ example.com"),
        ("host ᠑᠐.᠒.᠓.᠔ is up", "ip", "᠑᠐.᠒.᠓.᠔"), ("host \U0001e951\U0001e950.2.3.4 is up", "ip", "\U0001e951\U0001e950.2.3.4"),
    ],
)
def test_partly_disguised(text, kind, part):
    """A disguised part is found and redacted along with a plain one; plain spans stay."""
    base, spans = pii.find(text)
    at = text.index(part)
    assert (kind, at, at + len(part)) in spans and set(base) <= set(spans)
    assert pii.redact_text(text, spans) == text.replace(part, f"<{kind.upper()}>")


def test_prices_are_no_addresses():
    assert pii.find("five apples @ 3.50 each, a @ b") == ([], [])


def test_every_decimal_digit_is_strange():
    assert all(pii._STRANGE.match(chr(c)) and pii._FOREIGN.match(chr(c)) for c in range(128, 0x110000) if unicodedata.category(chr(c)) == "Nd")
