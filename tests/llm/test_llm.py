"""The ten operators on small tables against brute force, with the awkward cases: nulls in any
column, empty texts, ties, repeated rows, empty tables, extra columns."""

from __future__ import annotations

import bisect
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import decontaminate, html_extract, jaccard_join, packing, pii, quality_classifier, quality_rules, substring_dedup, token_rollup, tokens, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PROSE = "the quick brown fox jumps over the lazy dog while seven small wizards watch from a quiet hill near the old stone bridge and wait for rain to fall on dry ground again before night comes down".split()
EDGE = [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "One"), (905, "a b c d e"), (905, "a b c d e"), (906, "é😀 ñ word")]
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30000))


def _docs(spark, rows):
    full = [(i, t, "en" if (i or 0) % 2 else None, f"s{i % 3}" if (i or 0) % 5 else None, len(t or "")) for i, t in rows]
    df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({"key": F.lit(1), "n": F.lit("clash"), "digest": F.lit("x"), "item_id": F.lit(-1)})


def _varied(seed: int = 0, n: int = 40) -> list[tuple[int, str]]:
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        w = list(PROSE) if i % 2 else [f"t{int(x)}" for x in rng.integers(0, 400, 40)]
        for _ in range(int(rng.integers(0, 5))):
            w[int(rng.integers(len(w)))] = f"z{int(rng.integers(9))}"
        out.append((i, " ".join(w)))
    return out + EDGE + [(950, LONG), (951, LONG + " tail")]


def _set(text):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_jaccard_components_equal_brute_force(spark):
    rows = _varied()
    sets, root = [_set(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                root[find(i)] = find(j)
    low: dict[int, int] = {}
    for i, (doc, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), doc), doc)
    want = Counter((doc, len(sets[i]), low[find(i)]) for i, (doc, _) in enumerate(rows))
    got = Counter(tuple(r) for r in jaccard_join.jaccard_components(_docs(spark, rows)).collect())
    assert got == want


def test_keep_one_of_each(spark):
    docs = _docs(spark, [(1, " ".join(PROSE)), (2, " ".join(PROSE)), (3, "other words that stand alone here"), (3, "other words that stand alone here"), *EDGE[:3]])
    kept = jaccard_join.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 900, 901, 902]
    odd = [(None, " ".join(PROSE)), (7, " ".join(PROSE)), (8, "one text under an id of its own"), (8, " ".join([*PROSE, "more"])), (None, "a text without any id"), (None, None), (None, None)]
    docs = spark.createDataFrame(odd, "doc_id long, text string").withColumns({c: F.lit("mine") for c in ("id", "tag", "row", "stays", "group", "component_id")})
    kept = jaccard_join.keep_one_of_each(docs).collect()
    want = [odd[1], odd[2], odd[4], odd[5], odd[6]]
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept))) == sorted(map(str, want)) and all(r.stays == r.row == "mine" for r in kept)
    assert jaccard_join.keep_one_of_each(docs.limit(0)).count() == 0


@pytest.mark.parametrize("most", [20_000, 0])
def test_contained_items_equal_brute_force(spark, most):
    docs = [(1, "x y z " + " ".join(PROSE[:20]) + " tail"), (2, " ".join(PROSE[3:30])), (3, "nothing here to see at all"), *EDGE]
    docs += [(None, " ".join(PROSE)), (1, "nothing of note in this other text"), (4, f"{LONG} {' '.join(PROSE)}")]
    items = [(10, " ".join(PROSE[:14])), (11, " ".join(PROSE[5:25]).upper()), (12, "a b c d e"), (13, "one"), (14, None), (15, ""), (None, " ".join(PROSE[2:9]))]
    items += [(10, " ".join(PROSE[20:])), (12, "a b c d e"), (16, " ".join(PROSE * 2)), (17, " ".join(LONG.split()[500:900]))]
    want = Counter()
    for d, t in docs:
        for i, u in items:
            if _set(u) and 100 * len(_set(u) & _set(t)) >= 75 * len(_set(u)):
                want[(d, i)] += 1
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contained_items(_docs(spark, docs), b, max_broadcast=most).collect()
    assert Counter((r.doc_id, r.item_id) for r in got) == want
    assert decontaminate.contained_items(_docs(spark, docs).limit(0), b).count() == 0
    assert decontaminate.contained_items(_docs(spark, docs), b.limit(0)).count() == 0
    dirty = {(d, t) for d, t in docs for _, u in items if _set(u) and 100 * len(_set(u) & _set(t)) >= 75 * len(_set(u))}
    kept = decontaminate.drop_contaminated(_docs(spark, docs), b, max_broadcast=most)
    assert kept.columns == _docs(spark, docs).columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(x for x in docs if x not in dirty)


def _measures(t):
    t = t or ""
    w = WORD.findall(t)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_quality_measures_equal_brute_force(spark):
    rows = [*_varied(1, 12), (500, "a b c d e a b c d e f g a b c d e"), (501, "x\ny\nx\n\nx ## |"), (502, "no no no no no no no no no no no no")]
    got = quality_rules.quality_rules(_docs(spark, rows)).collect()
    want = Counter((d, *_measures(t)) for d, t in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) for r in got)
    assert not any(r.kept for r in got if r.base_failed)
    assert quality_rules.quality_rules(_docs(spark, rows).limit(0)).count() == 0
    clash = {c: F.lit("mine") for c in ("n_words", "base_failed", "kept", "host_rate", "host_rejected", "_found", "_host", "row")}
    docs = _docs(spark, rows).withColumns(clash)
    kept = quality_rules.keep_quality(docs)
    assert kept.columns == docs.columns and all(r[c] == "mine" for r in kept.collect() for c in clash)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if r.kept)
    assert quality_rules.keep_quality(docs.limit(0)).count() == 0


def test_bad_host_rejects_its_documents(spark):
    good = [(i, " ".join(PROSE), "en", "good", 1) for i in range(30)]
    bad = [(100 + i, "junk", "en", "bad", 1) for i in range(60)] + [(200, " ".join(PROSE), "en", "bad", 1)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.kept for r in quality_rules.quality_rules(docs).collect()}
    assert all(got[i] for i in range(30)) and not got[200]


def _luhn(d):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(d))) % 10 == 0


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _base(t):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, t):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False, "card": 12 <= len(d) <= 19 and _luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end(), kind))
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out))


def test_pii_base_spans_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    letters = list("aB1.-+@( )29%_4539 1\n,é😀")
    rows = [(i, "".join(rng.choice(letters, int(rng.integers(0, 120))))) for i in range(400)]
    rows += [(1000, None), (1001, ""), (1002, "a@b.c_x@y.com 1.2.3.4.5.6.7.8 0001.2.3.255 1.2.3.256 +1 (017) 555-7713, 4539 5787 6362 1486")]
    got = {r.doc_id: r for r in pii.pii_report(_docs(spark, rows)).collect()}
    for i, t in rows:
        assert got[i].base_sha256 == hashlib.sha256(_base(t or "").encode()).hexdigest(), t
    assert got[1002].n_email == 2 and got[1002].n_card == 1 and got[1002].n_phone == 1


def test_pii_method_spans_and_redaction(spark):
    text = "😀 x@y.zz IBAN: DE89 3704 0044 0532 0130 00 AND GB83WEST12345698765432 ssn 123-45-6789, lot 123-45-6789x"
    docs = _docs(spark, [(1, text), (2, "call 123-45-6789"), (3, None)])
    got = {r.doc_id: r.spans for r in pii.pii_report(docs).collect()}
    at = text.index("123-45")
    assert got == {1: f"email:2:8,iban:15:42,idnum:{at}:{at + 11}", 2: "", 3: ""}
    out = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert out[1].text.startswith("😀 [EMAIL] IBAN: [IBAN] AND GB83WEST") and out[1].n_chars == len(out[1].text)
    assert out[2].text == "call 123-45-6789" and out[3].text is None


def test_pii_of_a_text_with_many_matches(spark):
    n = 30_000
    text = "é " + " ".join(f"u{i}@host.example.com 10.0.0.{i % 300}" for i in range(n))
    docs = spark.createDataFrame([(1, text, "mine", "also")], "doc_id long, text string, _spans string, row string")
    r = pii.pii_report(docs).first()
    assert (r.n_email, r.n_ip) == (n, sum(i % 300 <= 255 for i in range(n)))
    assert r.base_sha256 == hashlib.sha256(_base(text).encode()).hexdigest()
    out = pii.redact(docs).first()
    assert (out["_spans"], out["row"]) == ("mine", "also")
    assert out.text == "é " + " ".join(f"[EMAIL] {'[IP]' if i % 300 <= 255 else f'10.0.0.{i % 300}'}" for i in range(n))


def test_pii_context_lowers_a_score(spark):
    rows = [(1, "card 4539578763621486"), (2, "order 4539578763621486"), (3, "x 4539578763621486"), (4, "serial 536-22-1234 ssn"), (5, "serial 536-22-1234")]
    got = {r.doc_id: r for r in pii.pii_report(_docs(spark, rows)).collect()}
    assert got[1].max_score > got[3].max_score > got[2].max_score and all(got[i].n_card == 1 for i in (1, 2, 3))
    assert got[4].spans and not got[5].spans
    assert pii.pii_report(_docs(spark, rows).limit(0)).count() == 0


def test_added_kinds_equal_brute_force(spark):
    """IBANs and id numbers against regular expressions and a plain mod-97."""
    rng = np.random.default_rng(6)

    def iban(ok):
        body = "".join(rng.choice(list("0123456789"), 16))
        check = 98 - int(body + "1314" + "00") % 97  # country code DE
        return f"DE{check if ok else (check + 1) % 90 + 2:02d}{body}"

    rows = [(i, f"{'ssn' if i % 2 else 'no'} {''.join(rng.choice(list('0123456789'), 3))}-12-3456 and {iban(i % 3 > 0)}.") for i in range(60)]
    got = {r.doc_id: r.spans for r in pii.pii_report(_docs(spark, rows)).collect()}
    for i, t in rows:
        want = []
        for m in re.finditer(r"DE\d{18,}", t):
            if int(m[0][4:] + "1314" + m[0][2:4]) % 97 == 1:
                want.append((m.start(), f"iban:{m.start()}:{m.end()}"))
        if i % 2:
            m = re.search(r"\d{3}-12-3456", t)
            want.append((m.start(), f"idnum:{m.start()}:{m.end()}"))
        assert [x for x in got[i].split(",") if x.startswith(("iban", "idnum"))] == [x for _, x in sorted(want)], t


def test_iban_before_capital_words(spark):
    iban = "AT61 1904 3002 3457 3201"
    rows = [(k, " ".join([iban, *"PAID FROM BANK".split()[:k]])) for k in range(4)]
    got = {r.doc_id: r.spans for r in pii.pii_report(_docs(spark, rows)).collect()}
    assert all(f"iban:0:{len(iban)}" in got[k].split(",") for k in range(4)), got


def test_tokens_of_both_files_agree():
    import public_tokenizers

    texts = ["", " ", "The cat\r\n\t sat.", "<|endoftext|> é😀", "a" * 3000, *[t or "" for _, t in EDGE]]
    one, two = (tokens.encoder(public_tokenizers.path(f"byte_bpe_50k.{x}"))(texts) for x in ("json", "tiktoken"))
    assert all(np.array_equal(a, b) for a, b in zip(one, two, strict=True))


def test_packing(spark):
    rows = [*_varied(2, 20), (970, "word " * 5000)]
    got = packing.pack(_docs(spark, rows)).collect()
    ids = {}
    for (d, _), x in zip(rows, tokens.encoder(tokens.default_vocabulary())([t or "" for _, t in rows]), strict=True):
        ids[d] = np.append(x, np.uint32(2)).astype("<u4")
    by_seq = defaultdict(list)
    for r in got:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        by_seq[r.sequence_id].append((r.offset, r.length))
    assert sum(r.length for r in got) == sum(len(ids[d]) for d, _ in rows)
    for places in by_seq.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:i]) for i in range(len(places))]
        assert sum(n for _, n in places) <= 1024
    assert all(r.length == 1024 for r in got if r.piece > 0)
    assert packing.pack(_docs(spark, rows).limit(0)).count() == 0


def _sequences(spark, lengths, room=1024):
    """Sequences of a packing of these lengths, which must be whole and gapless."""
    items = spark.createDataFrame(list(enumerate(int(x) for x in lengths)), "rid long, length long")
    got = packing.place(items, room).collect()
    assert sorted(r.rid for r in got) == list(range(len(lengths)))
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, int(lengths[r.rid])))
    for places in by.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= room
    return len(by)


def _best_fit(lengths, room=1024):
    """Plain best-fit-decreasing, piece by piece."""
    gaps, opened = [], 0
    for n in sorted(map(int, lengths), reverse=True):
        at = bisect.bisect_left(gaps, n)
        gap = gaps.pop(at) if at < len(gaps) else room
        opened += gap == room
        if gap > n:
            bisect.insort(gaps, gap - n)
    return opened


def test_sweeps_pack_as_well_as_best_fit(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANGE_ROWS", 40)  # many ranges, so that matches go across them
    rng = np.random.default_rng(1)
    cases = [rng.integers(1, 1025, 400), np.concatenate([np.full(150, 341), rng.integers(1, 600, 150)]), np.full(90, 300), (1024 * rng.random(300) ** 3 + 1).astype(int), np.array([5])]
    for lengths in cases:
        n, bound = _sequences(spark, lengths), -(-int(lengths.sum()) // 1024)
        assert bound <= n <= max(_best_fit(lengths) * 1.03 + 1, bound)


def test_sweeps_match_like_parentheses():
    """Matching inside ranges and then across them equals one sweep over all."""
    rng = np.random.default_rng(2)
    for _ in range(30):
        n = int(rng.integers(1, 60))
        kind = rng.integers(0, 2, n)
        whole = {(p, g) for p, g in packing.sweep(kind, kind)[0]}
        cuts = sorted(rng.integers(0, n + 1, 4).tolist())
        got, left, counts = set(), {}, {}
        for part, (a, b) in enumerate(zip([0, *cuts], [*cuts, n], strict=True)):
            met, pieces, gaps = packing.sweep(kind[a:b], kind[a:b])
            got |= {(p + a, g + a) for p, g in met}
            left[part, 0], left[part, 1] = [p + a for p in pieces], [g + a for g in gaps]
            counts[part, 0], counts[part, 1] = len(pieces), len(gaps)
        segments, stack = packing.across(counts)
        for _, p, high, g, low, k in segments:
            got |= {(left[p, 0][high - 1 - t], left[g, 1][low + t]) for t in range(k)}
        assert got == whole and sum(h - low for _, low, h in stack) == (kind == 0).sum() - len(whole)


def test_repeated_passages_are_found(spark):
    passage = " ".join(f"shared{i}" for i in range(60))
    own = lambda k: " ".join(f"own{k}n{i}" for i in range(80))
    rows = [(1, own(1) + " " + passage + " " + own(2)), (2, "é " + own(3) + " x " + passage), (3, own(4)), *EDGE]
    got = substring_dedup.repeated_runs(_docs(spark, rows)).collect()
    assert {r.doc_id for r in got} == {2} and all(1 in r.keeper_ids for r in got)
    text = rows[1][1].encode()
    assert all(text[r.start : r.end].decode() in passage for r in got)
    assert substring_dedup.repeated_runs(_docs(spark, rows).limit(0)).count() == 0


def test_repeated_runs_equal_brute_force(spark):
    """Passages of 50 to 70 words, of one-letter words too, beside copies that share only parts of them."""
    rng = np.random.default_rng(8)
    passages = [" ".join(f"{'abcdefghij'[int(x)]}{i if k % 2 else ''}" for i, x in enumerate(rng.integers(0, 10, 50 + k % 21))) for k in range(60)]
    own = lambda k: " ".join(f"own{k}n{i}" for i in range(int(rng.integers(0, 40))))
    rows = []
    for k, p in enumerate(passages):
        w = p.split(" ")
        rows += [(4 * k, f"{own(4 * k)} {' '.join(w[:40])}\n{own(-k)}"), (4 * k + 1, f"é {p}\t{own(4 * k + 1)}"), (4 * k + 2, f"{own(4 * k + 2)}\n{p}"), (4 * k + 3, f"{p} {own(4 * k + 3)} {p} {' '.join(w[:49])}")]
    rows += [(990, "la " * 180), (991, None), (992, ""), (993, rows[7][1]), (994, "x " + " ".join(t for _, t in rows[8:16]))]
    first: dict = {}
    places = {i: [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", (t or "").encode())] for i, t in rows}
    grams = [(i, p, p + 50, (t or "").encode()[places[i][p][0] : places[i][p + 49][1]]) for i, t in rows for p in range(len(places[i]) - 49)]
    for i, p, q, g in grams:
        first.setdefault(g, (i, p, q))
    want = defaultdict(list)
    for i, p, q, g in grams:
        d, _, end = first[g]
        if (d, _) != (i, p) and (d != i or p >= end):
            if want[i] and p < want[i][-1][1]:
                want[i][-1] = (want[i][-1][0], q, want[i][-1][2] | {d})
            else:
                want[i].append((p, q, {d}))
    got = substring_dedup.repeated_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.start, r.end, r.n_words, tuple(r.keeper_ids)) for r in got) == sorted((i, places[i][p][0], places[i][q - 1][1], q - p, tuple(sorted(k))) for i, runs in want.items() for p, q, k in runs)
    assert len({r.doc_id for r in got}) == 123


def test_repeats_of_odd_rows(spark):
    """A null doc_id, and two texts under one id; a repeated row repeats nothing."""
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(None, f"a {passage}"), (5, f"{passage} b"), (5, f"c c {passage}"), (6, "x " * 20), (7, passage + " z"), (7, passage + " z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"tag": F.lit("mine"), "hits": F.lit(1), "digest": F.lit(2)})
    got = sorted((r.doc_id, r.start, r.n_words, r.keeper_ids) for r in substring_dedup.repeated_runs(docs).collect())
    assert [(d, s, n) for d, s, n, _ in got] == [(5, 0, 60), (5, 4, 60), (7, 0, 60)]
    alone = spark.createDataFrame([rows[4], rows[4]], "doc_id long, text string")
    assert substring_dedup.repeated_runs(alone).count() == 0


def test_chunks_resist_insertions(spark):
    """An insertion changes the chunks around it and no other."""
    w = LONG.split()
    rows = [(1, LONG), (2, " ".join(["new", "words", "in", "front", *w[:9000], "and", "inside", *w[9000:]])), (3, None), (4, "a b c")]
    found = defaultdict(set)
    for r in substring_dedup.chunks(_docs(spark, rows)).collect():
        found[r.doc_id].add((r.h1, r.h2))
    assert set(found) == {1, 2} and len(found[1]) > 300
    assert len(found[1] ^ found[2]) <= 8


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/\r\nX: y", "<p>same</p>"), (2, None, "<p>same</p>"), (3, "u", None), (4, "u", ""), (5, "u", "é" * 70000), (6, "u", "x"), (6, "u", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"sha": F.lit(1), "winner": F.lit(2), "kind": F.lit(3)})
    got = warc.round_trip(pages).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in got if r.page_id < 6) == [(1, "revisit", 2), (2, "response", None), (3, "revisit", 4), (4, "response", None), (5, "response", None)]
    assert sorted(r.record_type for r in got if r.page_id == 6) == ["response", "revisit"]
    for r in got:
        body = next(h for i, _, h in rows if i == r.page_id) or ""
        assert r.payload_bytes == len(body.encode()) and r.payload_digest == warc.digest32(body.encode())
    sums = [sorted(tuple(x) for x in warc.write_warc(pages, f"file://{tmp_path}/{k}", shard_bytes=50_000, file_bytes=300).collect()) for k in "ab"]
    assert sums[0] == sums[1] and len(sums[0]) > 2
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_shards_follow_the_bytes(spark, tmp_path):
    """Outlying ids change no shard but their own; the ends of the 64-bit range are ids as well."""
    rows = [(i * 3, "u", f"{i} " + "x" * 400) for i in range(1500)]
    odd = [(10**12, "u", "far"), (2**63 - 1, "u", "last"), (-(2**63), "u", "first"), (None, "u", "none")]
    shards = []
    for k, some in enumerate((rows, rows + odd)):
        pages = spark.createDataFrame(some, "page_id long, url string, html string")
        made = warc.write_warc(pages, f"file://{tmp_path}/s{k}", shard_bytes=50_000).collect()
        assert sum(r.records for r in made) == len(some)
        shards.append(Counter(r.shard for r in made))
        assert max(r.records for r in made) < 80
        back = warc.read_warc(spark, f"file://{tmp_path}/s{k}").collect()
        want = {i: hashlib.sha1(h.encode()).digest() for i, _, h in some}
        assert {r.page_id: r.payload_digest for r in back} == {i: warc.base64.b32encode(d).decode() for i, d in want.items()}
    assert len(shards[0]) > 20 and abs(len(shards[1]) - len(shards[0])) <= 2


def test_warc_records_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), f"http://h/{i}", None if x == 0 else "é" * int(x)) for i, x in enumerate(rng.integers(0, 60, 300))]
    got = {r.page_id: r for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    last = {}
    for i, _, h in rows:
        last[h or ""] = i
    for i, url, h in rows:
        data, r = (h or "").encode(), got[i]
        assert (r.url, r.payload_bytes, r.payload_digest) == (url, len(data), warc.digest32(data))
        assert (r.record_type, r.refers_to) == (("response", None) if last[h or ""] == i else ("revisit", last[h or ""]))


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("<script>var a='</p>'", ""), ("<p>a &lt; b &amp c<p>d\n e", "a < b & c d e"),
        ("<nav><a href=x>Home</a></nav><article><h1>T</h1><p>x <b>y</b><br>z</p><aside>no</aside><div class='user-comments'>no</div></article><footer>f</footer>", "T x y z"),
        ("<div class=ad>Buy it</div><main><p>real</p><form><p>mail</p></form></main>", "real"),
        ("<!-- <p>no</p> --><body><p>kept</p>", "kept"),
    ],
)
def test_main_text(page, text):
    assert html_extract.main_text(page) == text


_TALK = "The cat and the dog are in the house with a lot of food, and they will not go out for the rest of the day because it is cold. " * 3


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<div class='layout has-sidebar'><article><p>{t}</p></article></div>", "{t}"),
        ("<div class='page-sidebar'><article><p>{t}</p></article></div>", "{t}"),
        ("<article><p>İ</p><SCRIPT>x</SCRIPT><p>{t}</p></article>", "İ {t}"),
        ("<article><p><a href=x>open link<p>{t}</p><p>{t}</p></article>", "{t} {t}"),
        ("<article><a href=x><div><p>{t}</p></div></a><p>{t}</p></article>", "{t}"),
        ("<article><div class='hidden md:block'><p>{t}</p></div><p title='a hidden word'>{t}</p><p hidden>no</p></article>", "{t} {t}"),
        ("<div><p>{t}</p></div><article><a href=x>Buy this now.</a></article><footer>no</footer>", "{t}"),
        ("<article><p>{t} <math><mi>x</mi><annotation>x</annotation></math><object>old</object></p></article>", "{t} x old"),
        ("<form id=all><div><p>{t}</p></div></form>", "{t}"),
        ("<form><p>Name</p><input></form>", ""),
        ("<article><p>{t}</p></article><div class=comments><article class=comment><p>I like the dog and the cat of it.</p></article></div>", "{t}"),
        ("<article><p>{t}</p><ul><li><a href=1>one</a></li></ul><p>Share</p><ul><li><a href=1>two</a></li></ul></article>", "{t}"),
        ("<div><p>{t}</p><p>Short one.</p></div><div><a href=1>a list</a> <a href=2>of links</a></div><p>Tail.</p>", "{t} Short one."),
        ("<main><nav>no</nav><article><header><h1>T</h1></header><p>x</p></article></main>", "T x"),
    ],
)
def test_block_rules(page, text):
    t = " ".join(_TALK.split())
    assert html_extract.main_text(page.replace("{t}", t)) == text.replace("{t}", t)


def test_extract_equals_the_generating_rule(spark):
    """Random pages built from known articles and boilerplate: what is kept is the articles' text."""
    rng = np.random.default_rng(12)
    rows, want = [], {}
    for i in range(120):
        words = lambda n: " ".join(rng.choice(PROSE, n))
        paragraphs = [words(int(rng.integers(3, 60))) for _ in range(int(rng.integers(1, 6)))] + [words(60)]
        body = "".join(f"<p>{p.replace(' ', rng.choice([' ', '  ', chr(10)]))}</p>" for p in paragraphs)
        junk = [f"<nav><a href=/>{words(3)}</a></nav>", f"<div class='cookie-notice'>{words(12)}</div>", f"<aside>{words(30)}</aside>", f"<footer>{words(9)}</footer>", f"<script>{words(4)}</script>", f"<form>{words(4)}</form>"]
        rng.shuffle(junk)
        rows.append((i, "u", f"<html><body>{''.join(junk[:3])}<{'article' if i % 2 else 'main'}><h1>T{i} &amp; co</h1>{body}</{'article' if i % 2 else 'main'}>{''.join(junk[3:])}</body></html>"))
        want[i] = " ".join([f"T{i} & co", *paragraphs])
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)
    big = "<article>" + "<p>the long page of it all</p>" * 20_000 + "<div>" * 3000
    assert len(html_extract.main_text(big)) == 20_000 * 24 - 1
    assert html_extract.extract(spark.createDataFrame(rows[:1], "page_id long, url string, html string").limit(0)).count() == 0


def test_extract_columns(spark):
    pages = spark.createDataFrame([(1, None, "<p>hello there</p>"), (2, "u", None)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    assert sorted(tuple(r) for r in html_extract.extract(pages).collect()) == [(1, None, "hello there", 11), (2, "u", "", 0)]


def test_classifier_learns_and_holds_out(spark):
    rng = np.random.default_rng(3)
    good = [(i, " ".join(rng.choice(PROSE, 40)), 1) for i in range(0, 240, 2)]
    bad = [(i, " ".join(f"{w}###" for w in rng.choice(PROSE, 40)), 0) for i in range(1, 240, 2)]
    rows = good + bad
    docs = _docs(spark, [(i, t) for i, t, _ in rows] + EDGE)
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_classifier.quality_scores(docs, labels).collect()}
    assert len(got) == len(rows) + len(EDGE) - 1
    out = [(got[i].predicted, q) for i, _, q in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    assert sum(p == q for p, q in out) >= 0.9 * len(out)
    none = quality_classifier.quality_scores(docs, labels.limit(0)).collect()
    assert {round(r.score, 6) for r in none} == {0.5}


def test_token_rollup_is_idempotent_and_signed(spark, tmp_path):
    docs = _docs(spark, _varied(4, 10))
    counts = token_rollup.count_tokens(docs, {"words@1": None}).cache()
    roll = token_rollup.TokenRollup(spark, f"file://{tmp_path}/r")
    assert roll.totals().count() == 0
    assert roll.commit("b1", token_rollup.inserts(counts)) and not roll.commit("b1", token_rollup.inserts(counts))
    total = lambda: roll.totals().agg(F.sum("n_docs"), F.sum("n_tokens")).first()
    want = counts.agg(F.count(F.lit(1)), F.sum("n_tokens")).first()
    assert tuple(total()) == tuple(want)
    gone = counts.where("doc_id < 4")
    assert roll.commit("b2", token_rollup.revisions(gone, gone.withColumn("n_tokens", F.col("n_tokens") + 5)))
    roll.compact()
    assert not roll.commit("b2", token_rollup.inserts(counts))
    assert roll.commit("b3", token_rollup.deletes(counts.where("doc_id >= 4")))
    assert tuple(total()) == (4, gone.agg(F.sum("n_tokens")).first()[0] + 20)


def test_token_counts_equal_the_encoder(spark):
    rows = _varied(5, 6)
    got = token_rollup.count_tokens(_docs(spark, rows)).collect()
    ids = tokens.encoder(tokens.default_vocabulary())([t or "" for _, t in rows])
    want = Counter((d, "byte_bpe_50k@1", len(x)) for (d, _), x in zip(rows, ids, strict=True)) + Counter((d, "words@1", len(WORD.findall(t or ""))) for d, t in rows)
    assert Counter((r.doc_id, r.tokenizer_version, r.n_tokens) for r in got) == want


def test_rollup_of_all_kinds_of_deltas(spark, tmp_path):
    """The totals equal those of a plain count; repeated commits and a lost writer change nothing."""
    rows = _varied(7, 30)
    docs = _docs(spark, rows)
    want = Counter()
    for r in docs.collect():
        want[(r.source, r.lang, "n")] += 1
        want[(r.source, r.lang, "t")] += len(WORD.findall(r.text or ""))
    root = f"file://{tmp_path}/all"
    got = token_rollup.rollup_documents(docs, root, {"words@1": None}).collect()
    assert {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in got} == {(s, g): (n, want[(s, g, "t")]) for (s, g, k), n in want.items() if k == "n"}
    again = token_rollup.rollup_documents(docs, root, {"words@1": None}).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    roll = token_rollup.TokenRollup(spark, f"file://{tmp_path}/lost")
    counts = token_rollup.count_tokens(docs, {"words@1": None})
    mark = roll._mark
    roll._mark = lambda *a: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        roll.commit("b1", token_rollup.inserts(counts))
    roll._mark = mark
    assert roll.totals().count() == 0 and roll.commit("b1", token_rollup.inserts(counts)) and not roll.commit("b1", token_rollup.inserts(counts))
    assert roll.totals().agg(F.sum("n_docs")).first()[0] == len(rows)
    assert token_rollup.rollup_documents(docs.limit(0), None, {"words@1": None}).count() == 0
