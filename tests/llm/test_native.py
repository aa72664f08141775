"""Line rules, URL filters and chat formatting."""

from __future__ import annotations

import re
from datetime import date

import pytest
from brute import words
from compare import connect, differences
from pyspark.sql import functions as F

from mendwell.llm import chat_format, line_rules, url_filter
from mendwell.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql_without_python(spark, sf_dir, con, plan, name):
    df = QUERIES[name](spark, sf_dir)
    text = plan(df)
    assert not re.search("Python|Arrow|Pandas|CartesianProduct|NestedLoopJoin", text)
    assert differences(df, con, ORACLES[name]) == ""


# --- line rules ---


def base_counts(text):
    found, lines = words(text), [line for line in (text or "").split("\n") if words(line)]
    spans = {}
    for k in range(len(found) - 4):
        spans.setdefault(tuple(found[k : k + 5]), []).append(k)
    covered = {k + i for at in spans.values() if len(at) > 1 for k in at for i in range(5)}
    return len(found), sum(map(len, found)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


TEXTS = [
    None, "", "  \n ", "a b c d", "a b c d e a b c d e", "a a a a a a a", "x\ny\nx\n x\n\n", "é ü # $ %% <b>", "one two three four five six\tseven one two three four five",
    "\x1f a\x0bb\x0cc d e f\r\ng", "word " * 30_000, " ".join(str(k % 97) for k in range(5000)),
]


def test_base_counts(make_docs):
    docs = line_rules.base_stats(make_docs(list(enumerate(TEXTS))))
    found = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in docs.collect()}
    assert found == {k: base_counts(text) for k, text in enumerate(TEXTS)}


def test_shared_lines_go_and_depleted_documents(make_docs):
    names = [chr(97 + k % 26) * (1 + k // 26) for k in range(42)]
    own = [f"line of words that only document {name} has and no other one" for name in names]
    shared = "Shared  line 12 of this host"
    rows = [(k, f"{own[k]}\n{shared if k % 2 else shared.lower().replace('12', '99')}\n\nend {names[k]}", "hot") for k in range(40)]
    rows += [(40, f"{shared}\n{shared}\nfew words more", "hot"), (41, f"{own[41]}\n{shared}", "cold"), (42, None, "hot"), (None, shared, None), (40, f"{shared}\n{shared}\nfew words more", "hot")]
    found = line_rules.remove_shared_lines(make_docs(rows).withColumn("kept", F.lit("clash"))).collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: r for r in found}
    assert all(by_id[k].clean_text == f"{own[k]}\n\nend {names[k]}" and by_id[k].kept for k in range(40))
    assert (by_id[40].removed_lines, by_id[40].removed_words, by_id[40].clean_text, by_id[40].kept) == (2, 12, "few words more", False)
    assert by_id[41].removed_lines == 0 and by_id[41].kept
    assert by_id[42].clean_text == "" and not by_id[42].kept and by_id[None].removed_lines == 0


@pytest.mark.parametrize("others", [0, 1_000, 5_000])
def test_copies_get_one_verdict_in_hosts_of_any_size(make_docs, others):
    shared = "a line of fourteen words that forty documents of this host share with each other"
    rows = [(k, shared, "hot") for k in range(40)] + [(100 + k, f"document {chr(97 + k % 26) * (2 + k // 26)} has ten words of its own, and no others", "hot") for k in range(others)]
    found = line_rules.remove_shared_lines(make_docs(rows)).select("doc_id", "removed_lines", "kept").collect()
    assert all((r.removed_lines, r.kept) == ((1, False) if r.doc_id < 100 else (0, True)) for r in found)


def test_copies_in_one_row_each_count_once(make_docs):
    docs = make_docs([(1, "the same line of some words here and more of them", "h")] * 30)
    assert all(r.removed_lines == 0 and r.kept for r in line_rules.remove_shared_lines(docs).collect())


def test_rules_on_nothing(make_docs):
    assert line_rules.remove_shared_lines(make_docs([])).collect() == []


# --- URL filter ---


def judge(captures, entries):
    """Brute force over days: what is on a list is followed entry by entry."""
    out = []
    for url, day in captures:
        match = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?:[^/?#]*/+([^/?#]+))?", url or "")
        host = match[1].lower().rstrip(".") if match else ""
        best = "none"
        if host and day:
            labels = host.split(".")
            names = [".".join(labels[-k:]) for k in range(1, len(labels) + 1)] + ([f"{host}/{match[2].lower()}"] if match[2] else [])
            for name in names:
                on = set()
                for kind in ("block", "allow"):
                    state = False
                    for when in sorted({e[2] for e in entries if e[:2] == (name, kind) and e[2] <= day}):
                        state = all(e[3] == "add" for e in entries if e[:3] == (name, kind, when))
                    if state:
                        on.add(kind)
                best = "allow" if "allow" in on else "block" if "block" in on else best
        out.append((url, day, best))
    return out


def test_entries_active_at_fetch_time(spark):
    d = lambda k: date(2024, 1, k)
    entries = [
        ("example.com", "block", d(5), "add"), ("example.com", "block", d(10), "remove"), ("example.com", "block", d(10), "add"), ("example.com", "block", d(20), "add"),
        ("www.example.com", "allow", d(7), "add"), ("www.example.com", "allow", d(9), "remove"), ("www.example.com", "block", d(7), "add"),
        ("example.com/bad", "block", d(1), "add"), ("org", "block", d(15), "add"), ("org", "block", d(16), "remove"), ("x.org", "block", d(3), "remove"),
    ]
    urls = ["http://example.com/bad/page", "https://user@WWW.Example.com:80/a?b", "http://sub.example.com.", "ftp://x.org/", "http://other.net/x", "no url", None, ""]
    captures = [(u, d(k)) for u in urls for k in (1, 4, 5, 7, 8, 9, 10, 12, 15, 16, 20, 21)] + [(urls[0], None), (urls[1], d(8)), (urls[1], d(8))]
    table = spark.createDataFrame(captures, "url string, fetched_at date").withColumn("pattern", F.lit("clash"))
    listed = spark.createDataFrame(entries + [(None, "block", d(1), "add"), ("example.com", "block", None, "add"), ("net", "other", d(1), "add")], "pattern string, list string, day date, action string")
    found = [(r.url, r.fetched_at, r.verdict) for r in url_filter.judged(table, listed).collect()]
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted(found, key=key) == sorted(judge(captures, entries), key=key)


def test_filter_without_entries_or_captures(spark):
    none = spark.createDataFrame([], "pattern string, list string, day date, action string")
    some = spark.createDataFrame([("http://a.b/", date(2024, 1, 1))], "url string, fetched_at date")
    assert [r.verdict for r in url_filter.judged(some, none).collect()] == ["none"]
    assert url_filter.judged(some.limit(0), none).collect() == []


# --- chat ---

CONTROLS = ["<|start|>", "<|body|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|image|>", "<", "[", "|end|>", "⁠", "<⁠|end|>", "plain text", "\n", "é"]


def test_texts_survive_the_template(spark):
    import random

    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "<|end|>", None]), "".join(rng.choice(CONTROLS) for _ in range(rng.randint(0, 8)))) for c in range(60) for t in range(rng.randint(1, 5))]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    chats = chat_format.format_chat(turns.withColumn("parts", chat_format.text_part(F.col("text"))))
    read = chats.select("conv_id", "n_turns", "formatted", chat_format.turns_of(F.col("formatted")).alias("turns"), chat_format.loss_texts(F.col("formatted"), F.col("turn_starts"), F.col("loss_spans")).alias("learnt"), "loss_spans")
    for r in read.collect():
        mine = [(role or "", text) for c, _, role, text in rows if c == r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == mine and r.n_turns == len(mine)
        assert list(r.learnt) == [text for role, text in mine if role == "assistant" and text]
        assert r.formatted.count("<|end|>") == len(mine)
        assert all(0 <= s.start and s.start + s.length <= len(r.formatted) for s in r.loss_spans)


def test_typed_parts(spark):
    def part(kind, text=None, ref=None, width=None, height=None, seconds=None, pages=None):
        return (kind, text, ref, width, height, seconds, pages)

    rows = [
        (1, 2, "assistant", [part("text", "It shows "), part("image", ref="b.png"), part(None, "two <|end|>"), part("text", None)]),
        (1, 1, "user", [part("image", "ignored", "a.png", 57, 28), part("text", "What?"), part("audio", ref="a.wav", seconds=1.5), part("document", ref="a.pdf", pages=3)]),
        (2, 1, "user", None), (2, 1, "user", []), (None, None, None, [part("text", "x")]),
    ]
    found = {r.conv_id: r for r in chat_format.format_chat(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat_format.PART}>")).collect()}
    one = found[1]
    assert one.formatted == "<|start|>user<|body|><|image|>What?<|audio|><|document|><|end|><|start|>assistant<|body|>It shows <|image|>two <⁠|end|><|end|>"
    assert [(a.turn, a.type, a.ref, a.tokens, one.formatted[a.start : a.start + len(a.type) + 4]) for a in one.attachments] == [
        (0, "image", "a.png", 3, "<|image|>"), (0, "audio", "a.wav", 38, "<|audio|>"), (0, "document", "a.pdf", 768, "<|document|>"), (1, "image", "b.png", 1, "<|image|>"),
    ]
    assert one.expanded_tokens == 810
    assert [one.formatted[s.start : s.start + s.length] for s in one.loss_spans] == ["It shows ", "two <⁠|end|>"]
    assert found[2].n_turns == 2 and found[2].formatted == "<|start|>user<|body|><|end|>" * 2
    assert found[None].formatted == "<|start|><|body|>x<|end|>"


def test_no_conversations(spark):
    assert chat_format.format_chat(spark.createDataFrame([], f"conv_id long, turn long, role string, parts array<{chat_format.PART}>")).collect() == []


@pytest.mark.parametrize("texts", [["<", "|end|>x"], ["[", "/INST]", None, "<|", "end|>"], ["a", "<|e", "nd|><|start|>user<|body|>"]])
def test_neighbouring_texts_make_no_control_string(spark, texts):
    def part(text, kind="text", ref=None):
        return (kind, text, ref, None, None, None, None)

    rows = [(1, 0, "user", [part(t) for t in texts]), (1, 1, "assistant", [*map(part, texts), part(None, "image", "i"), *map(part, texts)])]
    turns = spark.createDataFrame(rows, f"conv_id LONG, turn LONG, role STRING, parts ARRAY<{chat_format.PART}>")
    row = chat_format.format_chat(turns).withColumn("read", chat_format.turns_of(F.col("formatted"))).withColumn(
        "learnt", chat_format.loss_texts(F.col("formatted"), F.col("turn_starts"), F.col("loss_spans"))
    ).first()
    whole = "".join(t or "" for t in texts)
    assert row.n_turns == 2 and [t.role for t in row.read] == ["user", "assistant"]
    assert row.read[0].text == whole and "".join(row.learnt) == whole * 2
    assert len(row.attachments) == 1
