"""Lines whose signatures need more than the heads of their words."""

import hashlib

import pyarrow as pa

from parley.llm import line_dedup


def components(spark, lines):
    got = line_dedup.fuzzy_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()
    return [c for _, c in sorted((r.doc_id, r.component_doc) for r in got)]


def brute(lines):
    sets = [{x[i : i + 5] for i in range(len(x) - 4)} or {x} for x in lines]
    root = list(range(len(lines)))
    for b in range(len(lines)):
        for a in range(b):
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    return root


def token(k, n):
    return "".join(hashlib.sha256(f"{k} {i}".encode()).hexdigest() for i in range(n // 64 + 1))[:n]


def letters(k, n):
    return token(k, n).translate(str.maketrans("0123456789bf", "ghijlmnopqrs"))


def test_lines_of_long_tokens(spark):
    lines = []
    for k in range(12):
        for n in (70, 120, 200, 390, 450):
            own = letters(f"{k} {n}", n)
            lines += [own, "x" + own, own[: n // 2] + "-" + own[n // 2 :]]
        lines += [f"https://site{k}.example.org/{letters(k, 170)}", f"http://site{k}.example.org/{letters(k, 170)}"]
        lines += [f"{1000 + k},{token(('row', k), 200)}", f"{7000 + k},{token(('row', k), 200)}"]
        lines += [f"{letters(('a', k), 60)} {letters(('b', k), 60)}", f"q{letters(('a', k), 60)} q{letters(('b', k), 60)}"]
        eight = [letters(("w", k, i), 11) for i in range(8)]
        lines += [" ".join(eight), " ".join([eight[0][::-1]] + eight[1:]), " ".join(eight[:3] + [eight[3][:4] + "7" + eight[3][5:]] + eight[4:])]
    assert components(spark, lines) == brute(lines)


def test_repetitive_lines_of_several_lengths(spark):
    lines = ["-" * n for n in (6, 10, 40, 52, 63, 64, 80, 200, 399, 400, 900)] + ["word " * n for n in (8, 12, 60, 90, 120, 400)] + ["=-" * n for n in (20, 40, 300)] + ["1,2,3,4,5,6,7;" * n for n in (4, 9, 60)]
    lines = [x.strip() for x in lines]
    assert components(spark, lines) == brute(lines)


def family(n, planted):
    """Lines of one stem with tails of their own, and near copies of some."""
    stem = letters("stem", 200)
    lines = [stem + letters(("tail", i), 28) for i in range(n)]
    near = []
    for i in range(planted):
        tail = lines[i * 5][200:]
        near.append(stem + letters(("other", i), 8) + tail[8:] if i % 2 else stem + tail[:22] + letters(("other", i), 6))
    return lines + near


def test_no_link_is_lost_in_a_hot_band(spark):
    """1,500 lines that share their bands, most of them too far from each other, and 60 planted near copies."""
    n, planted = 1_500, 60
    found = components(spark, family(n, planted))
    assert [found[n + i] for i in range(planted)] == [found[i * 5] for i in range(planted)]
    assert len({found[i * 5] for i in range(planted)}) == planted


def test_splitting_bands_equals_all_pairs(spark, monkeypatch):
    """Families of families: the same components whatever bands are compared by all pairs."""
    lines = family(60, 12)
    for f in range(4):
        stem = letters(("family", f), 90)
        for g in range(6):
            mid = stem + letters(("mid", f, g), 30)
            lines += [mid + letters(("end", f, g, h), 4 + 9 * (h % 3)) for h in range(7)] + [mid[: 60 + 5 * g] + "." + mid[60 + 5 * g :]]
    told = []
    for size in (10**9, 4):
        monkeypatch.setattr(line_dedup, "ALL", size)
        told.append(components(spark, lines))
    assert told[0] == told[1] == brute(lines)


def test_a_band_of_one_component_and_few_others_is_not_split(spark, monkeypatch):
    """400 near copies of one line and 12 lines beyond them in the same bands: they are decided by their few pairs, in one round."""
    stem = letters("one", 220)
    lines = [stem + letters(("copy", i), 12) for i in range(400)] + [stem + letters(("far", i), 90) for i in range(10)]
    lines += [lines[400][:-9] + letters("near far", 9), lines[7] + letters("near copy", 8)]
    splits = []
    monkeypatch.setattr(line_dedup, "_split", lambda *args, split=line_dedup._split: splits.append(1) or split(*args))
    found = components(spark, lines)
    assert found == brute(lines) and len(set(found)) > 5 and not splits


def test_few_pairs_of_a_hot_band_are_compared(spark, monkeypatch):
    """120 lines that share their bands and do not link, and 12 near copies: nearly all pairs are told apart by bitmaps, before texts are joined to them."""
    stem = letters("hot", 200)
    lines = [stem + letters(("end", i), 48) for i in range(120)]
    lines += [lines[i * 7][:-6] + letters(("copy", i), 6) for i in range(12)]
    met = []
    monkeypatch.setattr(line_dedup, "_verified", lambda texts, pairs, verified=line_dedup._verified: met.append(pairs.count()) or verified(texts, pairs))
    assert components(spark, lines) == brute(lines)
    assert sum(met) < 3 * len(lines)


def test_bands_of_some_hundred_lines_are_not_split(spark, monkeypatch):
    """300 lines that share their bands, with more than MANY pairs of different components a line: pairs decide them, and few pairs need their texts."""
    lines, splits, met = [letters("hot", 200) + letters(("end", i), 48) for i in range(300)], [], []
    lines += [lines[i * 7][:-6] + letters(("copy", i), 6) for i in range(30)]
    monkeypatch.setattr(line_dedup, "_split", lambda *args, split=line_dedup._split: splits.append(1) or split(*args))
    monkeypatch.setattr(line_dedup, "_verified", lambda texts, pairs, verified=line_dedup._verified: met.append(pairs.count()) or verified(texts, pairs))
    assert components(spark, lines) == brute(lines)
    assert len(lines) > 2 * line_dedup.MANY and not splits and sum(met) < 4 * len(lines)


def test_pairs_of_one_component_are_not_compared(spark):
    """Of a band's rows only those beyond its largest component meet all others, and no pair of different components is left out."""
    rows = [(1, 10 + i, 5, 1 if i < 6 else i // 2) for i in range(11)] + [(2, 40 + i, 5, 40 + i % 3) for i in range(6)]
    groups = spark.createDataFrame([r[:3] for r in rows], "band long, row long, size long").selectExpr("*", "row as centre", "1L as rows")
    labels = spark.createDataFrame([(r[1], r[3]) for r in rows], "row long, root long")
    texts = spark.createDataFrame([(r[1], 5, *[0] * line_dedup.WORDS) for r in rows], ", ".join(f"{c} long" for c in ("row", "shingles", *line_dedup.MAP)))
    left = line_dedup._mixed(groups, labels, line_dedup.Scratch(spark))
    want = {(a[1], b[1]) for a in rows for b in rows if a[1] < b[1] and a[0] == b[0] and a[3] != b[3]}
    assert {r.band: r.main for r in left.collect()}[1] == 1 and left.agg({"pairs": "max"}).first()[0] == sum(a < 30 for a, _ in want)
    assert sorted((r.a, r.b) for r in line_dedup._apart(left, texts).collect()) == sorted(want)


def test_places_in_bits(spark):
    """Rows and bands by the places of a bitmap: of rows exactly those that are there, of bands at least these."""
    numbers = [k * 7919 + (k % 5 << 33) for k in range(4_000)]
    given, held = spark.createDataFrame([(n,) for n in numbers], "row long"), set(numbers[::3])
    bits = line_dedup._bits(given.where(line_dedup.F.col("row").isin(list(held))), line_dedup.F.col("row"))
    for there in (True, False):
        assert {r.row for r in line_dedup._among(given, bits, line_dedup.F.col("row"), there).collect()} == {n for n in numbers if (n in held) == there}
    tokens = spark.range(20_000).selectExpr("id as row", "5L as size", "xxhash64(if(id % 40 < 2, id div 40, id), id % 40 < 2) as band")
    assert line_dedup._grouped(tokens, line_dedup.Scratch(spark)).count() == 1_000


def test_bitmaps_keep_all_links(spark):
    """Lines about the bound between narrow and wide bitmaps, and longer ones, with near copies at and beyond the similarity."""
    lines = []
    for k in range(6):
        for n in (30, 380, 404, 430, 900):
            own = letters(f"map {k} {n}", n)
            lines += [own, own[: n - n // 10] + letters(("map", k, n), 3 * k), own[: n - 7 * k] if k else own + "x"]
    sizes, maps = line_dedup.parities(pa.array(lines))
    texts = spark.createDataFrame([(i, int(sizes[i]), *map(int, maps[i].view("int64"))) for i in range(len(lines))], ", ".join(f"{c} long" for c in ("row", "shingles", *line_dedup.MAP)))
    pairs = {(r.a, r.b) for r in line_dedup._side(texts, "a").crossJoin(line_dedup._side(texts, "b")).where("a < b").where(line_dedup._may_link()).select("a", "b").collect()}
    every = [(a, b) for b in range(len(lines)) for a in range(b)]
    links = [p for p, found in zip(every, line_dedup.similar(*(pa.array([lines[p[i]] for p in every]) for i in (0, 1))), strict=True) if found]
    assert len({(sizes[a] > line_dedup.NARROW, sizes[b] > line_dedup.NARROW) for a, b in links}) > 2
    assert len(links) > 60 and pairs >= set(links) and len(pairs) < 2 * len(links)
