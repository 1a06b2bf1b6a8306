import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import langid, linear, mixture, names, neardup, pii, residue, scans, sitelines, tokens, truncated


def test_tokens_against_library():
    tiktoken = pytest.importorskip("tiktoken")
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokens.RANKS, "rb"))}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    reference = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    encoder = tokens.Encoder(tokens.read_ranks(tokens.RANKS))
    rng = random.Random(1)
    texts = ["", " ", "<|endoftext|>", "a" * 5000, *("".join(rng.choice("ab's'tlreved  \n\t\xa0 1²½.,!'’éЖ漢🙂́") for _ in range(rng.randrange(40))) for _ in range(3000))]
    ids, sizes = encoder.encode(texts)
    at = 0
    for text, n in zip(texts, sizes, strict=True):
        own = ids[at : at + n].tolist()
        assert own == reference.encode_ordinary(text)
        assert encoder.decode(own) == text
        at += n


def test_token_column_nulls(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "two words", "x")], "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in tokens.encode_column(df, "doc_id", "text").collect()}
    assert got[1] == [] and got[2] == [] and len(got[3]) == 2
    assert tokens.encode_column(df.limit(0), "doc_id", "text").count() == 0


def test_bag_minhash_is_unbiased():
    rng = np.random.default_rng(3)
    m, errors = 256, []
    for _ in range(12):
        a, b = rng.integers(0, 5, 60).astype(float), rng.integers(0, 5, 60).astype(float)
        true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        e = neardup.mix(np.arange(60, dtype=np.uint64) + np.uint64(rng.integers(1 << 40)))
        w = np.concatenate([a, b])
        keep = w > 0
        names_ = neardup.bag_minhash(np.concatenate([e, e])[keep], w[keep], np.repeat([0, 1], 60)[keep], 2, m)
        errors.append((names_[0] == names_[1]).mean() - true)
    assert abs(np.mean(errors)) < 0.03


def test_near_duplicates_against_brute_force(spark, tmp_path):
    rng = random.Random(4)
    base = [[f"w{rng.randrange(4000)}" for _ in range(120)] for _ in range(30)]
    texts = []
    for words in base:
        texts.append(" ".join(words))
        for _ in range(3):
            copy = list(words)
            for _ in range(rng.randrange(0, 14)):
                copy[rng.randrange(len(copy))] = f"w{rng.randrange(4000)}"
            texts.append(" ".join(copy))
    texts += [texts[0], texts[0].upper(), None, "", "too short"]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, raw_content string").write.parquet(str(tmp_path / "content_item.parquet"))
    sets = {i: {tuple(w[k : k + 3]) for k in range(len(w) - 2)} for i, t in enumerate(texts) if t and len(w := t.lower().split()) >= 50}
    want = {(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= 0.6 * len(sets[i] | sets[j])}
    got = {(r.item_a, r.item_b) for r in neardup.p5_found(spark, str(tmp_path)).collect()}
    assert got <= want and len(got) >= 0.97 * len(want)
    links = {r.item_id: r.n_links for r in neardup.p5_groups(spark, str(tmp_path)).collect()}
    assert links == {i: sum(i in p for p in got) for i in sets}


def test_near_duplicates_edges(spark, tmp_path):
    same = " ".join(f"w{i}" for i in range(60))
    long = " ".join(f"v{i % 7000}" for i in range(120_000))
    rows = [(1, same), (2, same), (3, None), (4, ""), (5, long), (6, long + " x"), (7, "a b"), (8, same.upper())]
    spark.createDataFrame(rows, "item_id long, raw_content string").withColumn("bands", F.lit("clash")).write.parquet(str(tmp_path / "content_item.parquet"))
    assert {(r.item_a, r.item_b) for r in neardup.p5_found(spark, str(tmp_path)).collect()} == {(1, 2), (1, 8), (2, 8), (5, 6)}
    groups = {r.item_id: (r.rep, r.members, r.n_links) for r in neardup.p5_groups(spark, str(tmp_path)).collect()}
    assert groups == {1: (1, 3, 2), 2: (1, 3, 2), 8: (1, 3, 2), 5: (5, 1, 1), 6: (6, 1, 1)}


def test_site_lines(spark):
    rows = [(i, f"http://site{i % 2}.example/p{i}", f"Body {i} text{i * 7}abc\nShare THIS  story {i}\n", "webpage", None, "extra") for i in range(60)]
    rows += [(100, None, "Share this story", "webpage", None, "x"), (101, "http://site0.example/z", None, "webpage", None, "x")]
    df = spark.createDataFrame(rows, "item_id long, url string, raw_content string, content_type string, source_url string, k string")
    found = sitelines.excess_lines(sitelines.site_lines(df)).collect()
    assert {(r.site, r.k) for r in found} == {("site0.example", 30), ("site1.example", 30)}


def test_truncated_endings():
    kinds = {"It was late. The man wal": "word", "He said [+120 chars]": "mark", "All is well.": "closed", "He came,": "open", "Text.\nOslo, 2019": "closed", "Text. Two years later, the ind": "word", "Text.\n - 54 -": "closed", "Done. 🙂": "closed", "The man (a lawyer": "open"}
    for text, kind in kinds.items():
        assert truncated.ending(text)[0] == kind, text
    lengths = np.concatenate([np.arange(300, 900, 7), [1500]])
    found = truncated.limits_of(lengths, np.concatenate([np.ones(86, int), [60]]), 0)
    assert found and found[0][0] == 1500 and found[0][1] > 0.9


def _records():
    """(text, url, host) rows: plain pages, messages, filler and placeholders, and pages that mention such wording."""
    rng, rows = random.Random(5), []
    nouns = "council harbour ledger bridge school archive ferry orchard budget museum garden railway".split()
    verbs = "approved inspected rejected repaired sold measured described closed".split()
    notices = ["Page not found", "Please enable JavaScript to view this page.", "Service temporarily unavailable", "Too many requests", "Access denied"]
    tails = ["Request id 12345", "Reload the page after changing your settings.", "Loading...", "It may have been moved.", "nginx"]
    for i in range(900):
        site = f"site{i % 30}.example"
        body = " ".join(f"The {rng.choice(nouns)} {rng.choice(verbs)} the {rng.choice(nouns)} near the {rng.choice(nouns)}." for _ in range(rng.randrange(1, 25)))
        url, bad = f"https://{site}/p/{i}", False
        kind = i % 10
        if kind == 0:
            body, bad = f"{rng.choice(notices)}\n{rng.choice(tails)}", True
        elif kind == 1:
            body, bad = body + f" Dear {{{{{rng.choice(nouns)}}}}}, the {rng.choice(nouns)} waits.", True
        elif kind == 2:
            body += f" The manual explains that a template writes {{{{{rng.choice(nouns)}}}}} where a word will stand."
        elif kind == 3:
            body += f" The visitor said the site showed {rng.choice(notices)} for a day."
        elif kind == 4 and i % 20 == 4:
            url, bad = f"https://{site}/{{{{ page.url }}}}", True
        rows.append((body, url, site, bad))
    return rows


def test_truncated_planted(spark):
    rng = random.Random(12)
    nouns = "council harbour ledger bridge school archive ferry orchard budget museum garden railway".split()
    sentence = lambda: f"The {rng.choice(nouns)} near the {rng.choice(nouns)} approved the {rng.choice(nouns)} of the {rng.choice(nouns)}."
    rows, cut_ids = [], set()
    for i in range(700):
        text = " ".join(sentence() for _ in range(rng.randrange(2, 14)))
        if i % 3 == 0 and len(text) > 300:
            text = text[:300].rstrip() if text[299] != " " else text[:299] + text[300]
            if len(text) == 300 and text[-1] not in ". ":
                cut_ids.add(i)
        elif i % 50 == 1:
            text = text[: len(text) // 2].rsplit(" ", 1)[0] + "&nb"
            cut_ids.add(i)
        elif i % 7 == 2:
            text = text + "\nOslo, 2019"
        rows.append((i, "one" if i % 2 else "two", text))
    rows += [(9000, None, None), (9001, "one", ""), (9002, "two", " \n")]
    found = {r.doc_id for r in truncated.judged(spark.createDataFrame(rows, "doc_id long, source string, text string")).where("log_odds > 0").collect()}
    assert len(found & cut_ids) >= 0.95 * len(cut_ids) and len(found & cut_ids) >= 0.95 * len(found)
    assert truncated.judged(spark.createDataFrame(rows[:0] or [], "doc_id long, source string, text string")).count() == 0


def test_residue_decided_by_the_classifier():
    rows = _records()
    w, scale, least, report = residue.train([r[:3] for r in rows[:600]])
    p = residue.probabilities([r[0] for r in rows[600:]], [r[1] for r in rows[600:]], w, scale, linear.Hasher())
    bad, hit = np.array([r[3] for r in rows[600:]]), p >= least
    assert (hit & bad).sum() >= 0.95 * bad.sum() and (hit & bad).sum() >= 0.95 * hit.sum() and report["recall"] >= 0.9
    # an unlabelled notice is found by what it shares with labelled ones
    w, scale, least, _ = residue.train([r[:3] for r in rows[:600]], hidden=re.compile("too many requests"))
    alike = residue.probabilities(["Too many requests\nRequest id 12345"], ["https://new.example/p/1"], w, scale, linear.Hasher())[0]
    assert alike > 3 * residue.probabilities([r[0] for r in rows[605::10]], [None] * 30, w, scale, linear.Hasher()).max()


def test_residue_edges(spark):
    rows = [(1, None, None, None), (2, "", "https://a.example/{id}", None), (3, "  \n", "x", None), (4, "The council met. " * 40, "https://a.example/undefined-borders", "a.example")]
    df = spark.createDataFrame(rows, "item_id long, raw_content string, url string, source_url string")
    assert {r.item_id for r in residue.found(df).collect()} <= {2}
    assert residue.found(df.limit(0)).count() == 0
    assert residue.address_tokens("https://a.example/undefined-borders") is None and residue.address_tokens("https://a.example/?q={{name}}") and residue.address_tokens(None) is None
    assert linear.score(*linear.ngrams([[], ["a"]], linear.Hasher()), linear.fit(np.zeros(0, int), np.zeros(0, int), np.zeros(0))).max() < 0.01


def test_languages():
    judge = langid.Classifier(langid.build([("Le conseil a vendu la maison et le jardin pour une somme inconnue.", "fr"), ("The council sold the house and the garden for an unknown sum.", "en"), ("Der Rat hat das Haus und den Garten für eine unbekannte Summe verkauft.", "de-DE")]))
    got = langid.languages("The council sold the garden for the sum. Der Rat hat den Garten für eine Summe verkauft.", judge)
    assert [g[2] for g in got] == ["en", "de"] and langid.languages(None, judge) == [] and langid.languages("12 / 34", judge)[0][2] is None
    assert [langid.code_of(x) for x in ("RO", "de_AT", "eng", "French", "hu", "und", "", None)] == ["ro", "de", "en", "fr", "other", None, None, None]


def test_language_confidence_is_calibrated():
    rng = random.Random(4)
    pools = {k: langid.COMMON[k].split() for k in ("en", "fr", "de", "it")}
    rows = []
    for _ in range(900):
        k = rng.choice(list(pools))
        text = " ".join(rng.choice(pools[k]) for _ in range(rng.randrange(5, 12))) + "."
        rows.append((text, rng.choice(list(pools)) if rng.random() < 0.1 else k, k))
    dictionaries, scale = langid.fitted([(t, label) for t, label, _ in rows[:600]])
    judge = langid.Classifier(dictionaries, scale=scale)
    sure = [(judge(t), k) for t, _, k in rows[600:]]
    right = [found == k for (found, c), k in sure if found]
    mean = sum(c for (found, c), _ in sure if found) / len(right)
    assert sum(right) >= 0.95 * len(right) and abs(mean - sum(right) / len(right)) < 0.1
    assert langid.fitted([])[1] == 0.5


def test_shortlist_changes_nothing():
    texts = [("Le conseil a vendu la maison et le jardin pour une somme inconnue.", "fr"), ("The council sold the house and the garden for an unknown sum.", "en"), ("Il consiglio ha venduto la casa e il giardino per una somma ignota.", "it"), ("El consejo vendió la casa y el jardín por una suma desconocida.", "es")]
    judge = langid.Classifier(langid.build(texts))
    whole = langid.Classifier(langid.build(texts))
    whole.shortlist = lambda words: list(range(len(whole.names)))
    rng, words = random.Random(6), [t.split() for t, _ in texts]
    for _ in range(400):
        w = rng.choice(words)
        at = rng.randrange(len(w))
        piece = " ".join(w[at : at + rng.randrange(1, 14)])
        assert judge(piece)[0] == whole(piece)[0], piece


def test_confidence_weighs_every_language():
    dictionaries = langid.build([("Le conseil a vendu la maison et le jardin pour une somme inconnue.", "fr"), ("The council sold the house and the garden for an unknown sum.", "en")])
    judge = langid.Classifier(dictionaries, scale=0.05)
    for piece in ("the council", "la maison et le jardin", "The council sold the house and the garden for an unknown sum. " * 3 + "x9q7 zvkj wqpf " * 40):
        data = langid.folded(piece).encode()
        sizes = [len(tool.compress(data)) for tool in judge.tools]
        assert len(sizes) == len(langid.LANGUAGES) and abs(judge(piece)[1] - 1 / sum(2.0 ** (-0.05 * (n - min(sizes))) for n in sizes)) < 1e-12


def test_scans():
    lines = ["THE OLD TITLE OF BOOK    4", "the council rejected the annua1 budget and the loan was app-", "roved by the second council in the town and the budget was", "THE OLD TITLE OF BOOK    5", "approved by a narrow majority of the council in the second", "    [6]"]
    known = {"annual": 900, "approved": 500, "budget": 400, "council": 800, "the": 9000}
    reader = scans.Reader(known)
    assert scans.wrapped(lines) is True
    got = set(reader.damage(lines))
    assert {(0, "header"), (3, "header"), (5, "page"), (1, "hyphen"), (1, "ocr")} == got
    assert "annual budget and the loan was approved by" in reader.repair(lines)
    assert reader.damage([""]) == []


def test_scans_planted():
    rng = random.Random(15)
    vocabulary = "council annual harbour budget railway meeting approved rejected museum company settlement committee morning number common former summer volume remain minister".split()
    known = {w: 500 + 10 * i for i, w in enumerate(vocabulary)} | {"the": 90_000, "and": 50_000, "of": 80_000}
    reader, want, got = scans.Reader(known), set(), set()
    for doc in range(60):
        lines = []
        for page in range(3):
            lines.append(f"THE HARBOUR REPORT OF ELVER    {page + 1}")
            want.add((doc, len(lines) - 1, "header"))
            for _ in range(8):
                words = [rng.choice([*vocabulary, "the", "and", "of"]) for _ in range(9)]
                if rng.random() < 0.3:
                    k = rng.randrange(9)
                    read = words[k].replace("m", "rn", 1)
                    if read != words[k]:
                        words[k] = read
                        want.add((doc, len(lines), "ocr"))
                lines.append(" ".join(words) + " and the")
            lines.append(f"     - {page + 1} -")
            want.add((doc, len(lines) - 1, "page"))
        got |= {(doc, i, kind) for i, kind in reader.damage(lines)}
    assert len(got & want) >= 0.95 * len(want) and len(got & want) >= 0.95 * len(got)


def test_long_words_are_corrected():
    word = "internationalisierungsmoeglichkeitenkommission"
    known = {word: 900}
    reader = scans.Reader(known)
    assert reader.fix(word.replace("m", "rn", 1)) == word and reader.fix(word.replace("mm", "rnrn")) == word and reader.fix(word) is None


def test_scans_told_by_marks():
    page = ["the council met in the town hall again and the budget was app-", "roved there by a narrow majority of the second council in May"]
    assert scans.scanned([*page, "12"], "application/PDF") and not scans.scanned([*page[1:], "A short line."], "pdf")
    assert scans.scanned([*page, "\x0cTitle", "On.", "To.", "By.", "Of.", "In."], None)
    assert scans.scanned([page[1]] * 19 + ["x" * 140], "webpage")
    assert not scans.scanned(["a web page line that is very much longer than one hundred characters, as its paragraph is not wrapped at all-", "so"] * 5, "pdf")
    assert not scans.scanned([], "pdf") and not scans.scanned(["", " "], None)


def test_scans_rare_words(spark):
    page = ["the council met with mibrencilctti in the town hall again", "and the budget was approved there by oldrich kamandil-", "quez before the loan of the second council was rejected", "after which the council of the town went home at once."]
    long = "the " * 1_000_000  # so that words seen four times are below the table's frequency
    rows = [(1, "\n".join(page)), *((k, long) for k in (2, 3, 4)), *((k, "mibrenciletti kamandilquez kamandil quez " + "x" * 90) for k in (5, 6, 7, 8))]
    df = spark.createDataFrame(rows, "item_id long, raw_content string").withColumn("content_type", F.lit(None).cast("string"))
    table, least = scans.frequent(scans.word_counts(df.select("raw_content", "content_type")))
    assert least > 4 and "mibrenciletti" not in table
    assert {tuple(r) for r in scans.damaged_lines(df).collect()} == {(1, 0, "ocr"), (1, 1, "hyphen")}
    assert "met with mibrenciletti in the town hall again and the budget was approved there by oldrich kamandilquez before" in scans.repaired(df).first().text
    pairs = spark.createDataFrame([("x" + a + "y", "x" + b + "y") for a, b in scans.CONFUSIONS], "a string, b string")
    assert pairs.where(scans.confusion_key(F.col("a")) != scans.confusion_key(F.col("b"))).count() == 0


def _sentences(n, seed):
    """(text, planted spans as (kind, start)) rows."""
    rng, rows = random.Random(seed), []
    given = "Maria Ioana Petru Vasile Robert Clara Anton Helga Silvia Pavel".split()
    sur = [a + b + "escu" for a in "PopIonStanMarinLucaDanRad".replace("S", " S").replace("I", " I").replace("M", " M").replace("L", " L").replace("D", " D").replace("R", " R").split() for b in ("", "an", "il", "or", "un")]
    phone = [lambda: f"+44 20 7946 0{rng.randrange(100, 999)}", lambda: f"0040 7{rng.randrange(10**7, 10**8)}", lambda: f"020 7946 0{rng.randrange(100, 999)}"]
    ident = [lambda: f"{rng.randrange(10**8, 10**9)}J"[-9:], lambda: f"{rng.randrange(900, 999)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}"]
    for _ in range(n):
        name, tel, code = f"{rng.choice(given)} {rng.choice(sur)}", rng.choice(phone)(), rng.choice(ident)()
        shape = rng.randrange(7)
        parts = [
            [("NAME", name), (None, ", phone "), ("PHONE", tel), (None, ", runs the archive.")],
            [("NAME", name), (None, ", identity number "), ("ID", code), (None, ", resigned.")],
            [(None, "The file "), (None, str(rng.randrange(10**7, 10**8))), (None, " was closed by Harbour Trust Ltd.")],
            [(None, "The agency lists "), ("PHONE", tel), (None, " as its switchboard.")],
            [(None, "Dr. "), ("NAME", f"{rng.choice('ABCDE')}. {rng.choice(sur)}"), (None, " moved to "), ("ADDRESS", f"{rng.randrange(1, 99)} Orchard Lane"), (None, " in 2014.")],
            [(None, "Write to "), ("EMAIL", f"{rng.choice(given).lower()}.x{rng.randrange(99)}@mail{rng.randrange(9)}.example"), (None, " before Friday.")],
            [(None, "According to "), ("NAME", f"{rng.choice('ABCDE')}. {rng.choice(sur)}"), (None, ", the council met in Port Elverin.")],
        ][shape]
        text, spans = "", set()
        for kind, piece in parts:
            if kind:
                spans.add((kind, len(text)))
            text += piece
        rows.append((text, spans))
    return rows


def test_pii_planted():
    model = pii.train([t for t, _ in _sentences(2500, 1)])
    fresh = _sentences(600, 2)
    found = pii.find([t for t, _ in fresh], model)
    got = [{(pii.KINDS[k], a) for k, a, _ in f} for f in found]
    both, want, have = sum(len(g & w) for g, (_, w) in zip(got, fresh, strict=True)), sum(len(w) for _, w in fresh), sum(map(len, got))
    assert both >= 0.95 * want and both >= 0.95 * have
    assert model["report"]["silent"] > 0 and model["report"]["labelled"] > 0
    # a span that no rule labels is decided by the trees: its kind's calibrated score, not a rule
    text = "The agency lists 020 7946 0123 as its switchboard."
    c = next(c for c in pii.candidates(text, set()) if c[0] == pii.PHONE)
    assert pii.weak_label(text, c, pii.features(text, c, model["lexicon"])) is None and ("PHONE", 17) in {(pii.KINDS[k], a) for k, a, _ in pii.find([text], model)[0]}


def test_pii():
    model = pii.train([t for t, _ in _sentences(800, 3)])
    sentence = "Maria Popescu wrote from a.b@x.example about 48 Orchard Lane."
    found = pii.find([sentence, None, "", "x" * 200_000], model)
    assert {pii.KINDS[k] for k, _, _ in found[0]} >= {"EMAIL", "ADDRESS", "NAME"} and found[1] == found[2] == found[3] == []
    assert "a.b@x" not in pii.redact(sentence, found[0])
    empty = pii.train([])
    assert pii.find([sentence], empty) is not None and empty["report"]["labelled"] == 0


def test_pii_learns_from_all_rows(spark):
    rare = [f"Oldrich Kamand{x}escu signed the lease." for x in "aeiou"] + [f"Zdenka Brin{x}escu signed the lease." for x in "aeiou"]
    texts = [t for t, _ in _sentences(14_000, 5)] + ["", *rare]  # more rows than the samples of before
    rows = spark.createDataFrame([(f"r{i}", t) for i, t in enumerate(texts)] + [("none", None)], "row_key string, text string").repartition(4)
    model, lex = pii._model(rows), pii.Lexicon(texts[:14_000] + rare)
    assert {"oldrich", "zdenka"} <= lex.given
    assert (model["lexicon"].given, model["lexicon"].endings, model["lexicon"].plain) == (lex.given, lex.endings, lex.plain)
    assert model["report"]["spans"] == sum(len(pii.candidates(t, lex.given)) for t in texts if t)
    found = {(r.row_key, r.start_pos) for r in pii.spans(rows).where("kind = 'NAME'").collect()}
    assert {(f"r{i}", 0) for i in range(14_001, len(texts))} <= found
    clean = {r.row_key: r.text for r in pii.redacted(rows.where("text is not null")).collect()}
    assert len(clean) == len(texts) and clean["r14000"] == "" and clean["r14001"] == "[NAME] signed the lease."
    assert pii.spans(rows.limit(0)).count() == 0


def test_pii_title_or_initial():
    spans = lambda t: {t[a:b] for k, a, b, _ in pii.candidates(t, {"maria"}) if k == pii.NAME}
    assert spans("M. Mibrenciletti can be reached") == {"M. Mibrenciletti", "Mibrenciletti"}
    assert spans("Dr. M. Macuhamovan moved") == {"M. Macuhamovan", "Macuhamovan"}
    assert spans("Frau Macuhamovan moved") == {"Macuhamovan"}
    assert pii.initial_m("M. Mibrenciletti signed", 0, 16, set()) == 2 and pii.initial_m("M. Mibrenciletti est joignable", 3, 16, set()) == 3
    assert pii.initial_m("M. Maria Stanescu signed", 0, 17, {"maria"}) == 1


def test_pii_scores_each_distinct_row_once(monkeypatch):
    texts = [t for t, _ in _sentences(800, 3)]
    model = pii.train(texts)
    found, scored, predict = pii.find(texts, model), [], pii.trees.predict
    distinct = {tuple(pii.features(t, c, model["lexicon"])) for t in texts for c in pii.candidates(t, model["lexicon"].given)}
    monkeypatch.setattr(pii.trees, "predict", lambda m, x: scored.append(len(x)) or predict(m, x))
    assert pii.find(texts * 5, model) == found * 5 and sum(scored) == len(distinct)


def test_pii_forms_of_spans():
    spans = lambda t, kind: {t[a:b] for k, a, b, _ in pii.candidates(t, {"maria"}) if k == kind}
    for t in ("Alte Gasse 3", "Hauptstraße 12", "C/Mayor 7", "12 rue Haute", "str. Lunga 4", "48 Orchard Lane"):
        assert spans(f"{t}, 2014", pii.ADDRESS) == {t}
    assert spans("aMaria Popescu, É. Ion-Dan Pop, Maria signed", pii.NAME) == {"Popescu, É. Ion-Dan Pop, Maria", "É. Ion-Dan Pop, Maria"}
    text = "x12 34 567 89 met (40) 721 234 567 and RO 12345"
    assert spans(text, pii.PHONE) == {"12 34 567 89", "(40) 721 234 567"} and spans(text, pii.ID) == {"12 34 567 89", "RO 12345"}


def test_names():
    given = {"richard", "ursula", "francisco"}
    a, b = names.spelling("Prof. Richard Megolanquez", given)[0], names.spelling("Megolanquez, R.", given)[0]
    assert a[1] == b[1] and names.agreement(a, b, given) >= names.LINKAGE
    assert names.agreement(names.spelling("Ursula Cildebaidis", given)[0], names.spelling("Francisco Cildebaidis", given)[0], given) == 0
    assert names.spelling(None, given) == [] and names.spelling("HTB", given) == []
    made = names.clusters([("k1", "Q1", None, [a]), ("k2", "Q2", None, [a]), ("k3", None, None, [a])], given)
    assert all(len({"k1", "k2"} & {("k1", "k2", "k3")[i] for i in c}) < 2 for c in made)


def test_clusters_against_plain_linkage():
    rng = random.Random(9)
    given, sur = "maria ioana petru vasile robert clara anton helga".split(), "kamandil"
    for _ in range(30):
        entries = [(f"k{i}", rng.choice([None, None, "Q1", "Q2"]), rng.choice([None, None, "a", "b"]), [("PERSON", sur, rng.choice([*given, "m", "r", "c"]), "")]) for i in range(rng.randrange(1, 12))]
        made = {frozenset(c) for c in names.clusters(entries, set(given))}
        assert sorted(i for c in made for i in c) == list(range(len(entries)))
        for c in made:  # no two qids in one cluster
            assert len({entries[i][1] for i in c} - {None}) <= 1


def test_one_slip_links(spark):
    rows = [("k1", "Zoltán Kogarethan", "Q1"), ("k2", "Zoltán Kogaerthan", None), ("k3", "Zoltan Kogarethn", None), ("k4", "Kogarethan, Z.", None), ("k5", "Maria Kogarethan", "Q5")]
    cache = spark.createDataFrame(rows, "cache_key string, entity_text string, qid string").selectExpr("*", "entity_text as label", "cast(null as string) as aliases", "cast(null as string) as description")
    evidence = spark.createDataFrame([("p0", "Zoltán Kogaerthan met the council."), ("p1", None), ("p2", "")], "prov_id string, text string")
    keys, named = names.linked(cache, evidence)
    group = {r.cache_key: r.cluster for r in keys.collect()}
    assert group["k1"] == group["k2"] == group["k3"] == group["k4"] != group["k5"]
    assert {r.cluster for r in named.collect()} == {group["k1"]}


def test_names_in_lower_case(spark):
    cache = spark.createDataFrame(
        [("k1", "Gheorghe Kamandilquez", "Q1"), ("k2", "Lake Mordrinova", "Q2")], "cache_key string, entity_text string, qid string"
    ).selectExpr("*", "entity_text as label", "cast(null as string) as aliases", "cast(null as string) as description")
    texts = ["gigi kamandilquez fue nombrado contable de la empresa", "they went to lake mordrinova in may", "it was kamandilquez, vasile's friend", "signed by kamandilqez, gigi", "the lake was cold"]
    evidence = spark.createDataFrame(list(enumerate(texts)), "id long, text string").selectExpr("concat('p', id) as prov_id", "text")
    keys, named = names.linked(cache, evidence)
    assert {(r.cache_key, r.prov_id) for r in keys.join(named, "cluster").collect()} == {("k1", "p0"), ("k1", "p3"), ("k2", "p1")}


def test_cores_follow_to_the_end(spark):
    chain = ["kamandilquezbrontiv", "kamandilquezbrontix", "kamandilquetbrontix", "kamandilruetbrontix", "kamasdilruetbrontix"]  # each one slip from the next
    others = [a + b + c + a for a in ("gof", "lyp", "wuh") for b in "aeiouy" for c in ("jeg", "pow", "cyf", "hul", "xug", "fod")]
    counts = spark.createDataFrame([*(("PERSON", c, 10 * k + 1) for k, c in enumerate(chain)), *(("PERSON", x, 1) for x in others), ("ORG", chain[0], 900)], "kind string, core string, n long")
    assert {r.canon for r in names.canonical_cores(counts).where("core like 'kama%' and kind = 'PERSON'").collect()} == {chain[-1]}


def test_cores_follow_any_near_one(spark):
    slip, true = "kamandilquezbron", "kamandulquezbron"
    nearer = [slip[:-1] + x for x in "bcdfghklmprstv"]  # fourteen, whose cosine with the slip is higher
    long = "brinov" * 25
    counts = spark.createDataFrame(
        [("PERSON", slip, 2), ("PERSON", true, 50), *(("PERSON", x, 1) for x in nearer), ("PLACE", "kohl", 9), ("PLACE", "kohll", 1), ("ORG", long, 9), ("ORG", long[:3] + "x" + long[3:], 1)], "kind string, core string, n long"
    )
    canon = {(r.kind, r.core): r.canon for r in names.canonical_cores(counts).collect()}
    assert len(canon) == counts.count() and canon["PERSON", slip] == true and {canon["PERSON", x] for x in nearer} == {true}
    assert canon["PLACE", "kohll"] == "kohl" and canon["ORG", long[:3] + "x" + long[3:]] == long


def test_given_names_of_all_names(spark):
    rare = [(f"Oldrich Ka{a}{b}mandil",) for a in "abcd" for b in "efgh"] + [(f"Za{a}{b}{c}rin Qua{c}{b}{a}lin",) for a in "bcdfghklmn" for b in "aeiou" for c in "bcdfghklmnprstvz"]
    assert "oldrich" in names.frequent_names(spark.createDataFrame(rare, "name string")) and "quabablin" not in names.frequent_names(spark.createDataFrame(rare, "name string"))


def test_mixture(spark):
    rows = [(i, "alpha", "word " * (5 + i % 7)) for i in range(200)] + [(1000 + i, "beta", "one two " * 6) for i in range(10)] + [(2000, "gamma", None), (2001, "delta", "not listed")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got, report = mixture.mixture(df, {"alpha": (1.0, 1), "beta": (1.0, 4), "gamma": (1.0, 2), "none": (1.0, 1)})
    taken = got.collect()
    total = {s: sum(r.copies * r.n_tokens for r in taken if r.source == s) for s in ("alpha", "beta")}
    assert abs(total["alpha"] / sum(total.values()) - 0.5) < 0.02 and max(r.copies for r in taken if r.source == "beta") <= 4
    assert mixture.mixture(df, {})[0].count() == 0 and mixture.mixture(df.limit(0), {"alpha": (1.0, 1)})[0].count() == 0


def test_mixture_dual_binds(spark):
    rng = random.Random(8)
    rows = [(i, "short", "a " * rng.randrange(3, 30)) for i in range(400)] + [(1000 + i, "long", "b " * rng.randrange(20, 200)) for i in range(300)] + [(2000 + i, "few", "c " * 40) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got, report = mixture.mixture(df, {"short": (2.0, 2), "long": (2.0, 1), "few": (1.0, 3)})
    solved = report["sources"]
    assert report["newton_steps"] > 3 and report["gap"] <= 1e-6 and solved["short"].b > 0.1 and solved["long"].b < -0.1
    taken = got.collect()
    size = {s: sum(r.copies * r.n_tokens for r in taken if r.source == s) for s in solved}
    reached = {s: v / sum(size.values()) for s, v in size.items()}
    assert abs(reached["short"] - 0.4) < 0.01 and abs(reached["long"] - 0.4) < 0.01 and abs(reached["few"] - 0.2) < 0.01
    for s, cap in (("short", 2), ("long", 1), ("few", 3)):
        assert max(r.copies for r in taken if r.source == s) <= cap
    # the mean lengths taken are nearer to one another than those of the sources are
    mean = {s: size[s] / sum(r.copies for r in taken if r.source == s) for s in size}
    assert abs(mean["long"] - mean["short"]) < 0.8 * abs(solved["long"].mean - solved["short"].mean)
