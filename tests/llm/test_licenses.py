from __future__ import annotations

import random
import re

from compare import connect, differences

from mendwell.llm import licenses
from mendwell.llm.license_templates import NOTICES, TEXTS
from mendwell.llm.queries import ORACLES, QUERIES


def brute(text, known):
    """Matches and labels of one text; every block meets every template."""
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    base = [(k, label) for label, before in licenses.PHRASES.items() for k in range(len(words)) if words[k : k + len(before) + 1] == [*before, "license"]]
    matches, said = [], {label for _, label in base}
    for kind, blocks in (("paragraph", re.split(r"\n[\x20\x09\x0B-\x0D]*\n", low)), ("line", low.split("\n"))):
        for at, block in enumerate(blocks):
            held = set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", block))
            found = [t for t in known if t.kind == kind and len(held & set(t.tokens)) >= t.need]
            matches += [(kind, at, t.label, len(held & set(t.tokens)) / len(t.tokens)) for t in found]
            said |= {t.label for t in found if not any(set(t.tokens) < set(u.tokens) for u in found)}
    starts = [k for k, _ in base]
    score = 1.0 if base else max((m[3] for m in matches), default=0.0)
    return (len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({b for _, b in base})), ",".join(sorted(said)), score, sorted(matches))


def plain(r):
    return (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["score"], [tuple(m) for m in r["matches"]])


def test_query_equals_sql(spark, sf_dir):
    assert differences(QUERIES["op12_license_scan"](spark, sf_dir), connect(sf_dir), ORACLES["op12_license_scan"]) == ""


def test_equals_brute_force_on_changed_templates(spark, make_docs):
    rng = random.Random(5)
    texts = ["", "license", "MIT license, mit LICENSE; Apache\tLicense\nGeneral Public License general license", "Kelvin \u212a mit-license İ", "a\n \n\nb"]
    for source in [*TEXTS.values(), *NOTICES.values()]:
        for lost in (0, 0.1, 0.2, 0.3, 0.5):
            words = [w for w in source.split() if rng.random() >= lost]
            if lost == 0.1:
                rng.shuffle(words)
            texts.append("Some words before.\n" + " ".join(words).upper() + "\n\nAnd the others of it: " + " ".join(rng.choices(source.split(), k=8)))
    texts.append("\n".join(texts[5:]))
    texts.append("\n\n".join(texts[5:]))
    docs = make_docs([(k, t) for k, t in enumerate(texts)])
    known = licenses.templates()
    got = {r["doc_id"]: plain(r) for r in licenses.license_scan(docs).collect()}
    assert got == {k: brute(t, known) for k, t in enumerate(texts)}
    assert sum(bool(v[7]) for v in got.values()) > 40


def test_low_thresholds_and_rare_words_first(spark, make_docs):
    texts = {"x": "aa bb cc dd ee ff", "y": "aa bb cc dd ee ff gg hh", "z": "zz yy"}
    known = licenses.templates(texts, {"n": "aa bb"}, text_share=0.5)
    rng = random.Random(9)
    docs = [(k, " ".join(rng.choices("aa bb cc dd ee ff gg hh ii jj".split(), k=rng.randint(0, 12)))) for k in range(120)]
    got = {r["doc_id"]: plain(r) for r in licenses.license_scan(make_docs(docs), known=known).collect()}
    assert got == {k: brute(t, known) for k, t in docs}


def test_wider_notice_silences_the_narrower(spark, make_docs):
    rows = [(1, "Licensed under CC BY-NC 4.0."), (2, "Licensed under CC BY 4.0.\nLicensed under CC BY-NC 4.0."), (3, "licensed under the GNU Lesser General Public License")]
    got = {r["doc_id"]: (r["labels"], r["base_labels"]) for r in licenses.license_scan(make_docs(rows)).collect()}
    assert got == {1: ("cc-by-nc", ""), 2: ("cc-by,cc-by-nc", ""), 3: ("gpl,lgpl", "gpl")}


def test_nulls_repeats_long_and_empty(spark, make_docs):
    long = "filler words here " * 60_000 + TEXTS["mit"]
    rows = [(None, None), (None, "MIT License"), (1, ""), (1, ""), (2, long), (3, " ,;\n")]
    got = sorted(((r["doc_id"] or -1, plain(r)) for r in licenses.license_scan(make_docs(rows)).collect()), key=str)
    known = licenses.templates()
    assert got == sorted(((i or -1, brute(t, known)) for i, t in rows), key=str)
    assert licenses.license_scan(make_docs([])).collect() == []


def test_clashing_columns_and_no_python(spark, make_docs, plan):
    docs = make_docs([(1, "mit license")]).selectExpr("*", "1 AS _row", "2 AS labels", "3 AS kind", "4 AS n_words", "5 AS token")
    out = licenses.license_scan(docs)
    assert plain(out.first()) == brute("mit license", licenses.templates())
    assert "Python" not in plan(out) and "Pandas" not in plan(out)
