"""Operator 7 against brute force."""

from sitelens.llm import unit_dedup as U


def brute(rows, **options):
    """doc_id -> (removed spans, kept text); ids are unique here."""
    first, out = {}, {}
    for doc_id, text in sorted(rows):
        later = []
        for start, end, unit in sorted(U.units_of(text or "", **options)):
            if unit in first:
                later.append((start, end))
            else:
                first[unit] = (doc_id, start)
        spans, reach = [], -1
        for s in sorted(later, key=lambda s: (s[0], -s[1])):
            if s[1] > reach:
                spans.append(s)
                reach = s[1]
        kept, at = "", 0
        for s, e in spans:
            kept, at = kept + text[at:s], e
        out[doc_id] = (spans, kept + (text or "")[at:])
    return out


def result(df, **options):
    found = U.removed_units(df, **options)
    return {r.doc_id: ([tuple(s) for s in r.removed or ()], r.kept_text) for r in U.kept_texts(df, found).collect()}


def test_equals_brute_force(llm_docs):
    rows, df = llm_docs
    want = brute(rows)
    assert result(df) == want
    assert result(df, unit="paragraph", min_sentence=0) == brute(rows, unit="paragraph", min_sentence=0)
    assert sum(bool(v[0]) for v in want.values()) > 30


def test_units_and_normal_form():
    text = "One  TWO three.\n\n \none two THREE.\nA b c d. E f g h! x"
    assert [u[2] for u in U.units_of(text, min_sentence=4)] == ["one two three.", "one two three.", "a b c d. e f g h! x", "a b c d.", "e f g h!"]
    assert [text[u[0]:u[1]] for u in U.units_of(text, unit="paragraph", min_sentence=0)][0] == "One  TWO three."


def test_passage_in_the_middle_of_a_line(spark):
    passage = " ".join(f"Sentence number {i} of the passage has quite some words in it." for i in range(6))
    rows = [(1, "Own start of one. " + passage + " Own end."), (2, "Another begin here. " + passage + " Another end."), (3, "Clean text.")]
    got = result(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got[1][0] == [] and got[3][0] == []
    assert sum(e - s for s, e in got[2][0]) > 0.9 * len(passage)
    assert "Another begin here." in got[2][1] and "Another end." in got[2][1]


def test_edge_rows(edge_docs, no_docs):
    found = U.removed_units(edge_docs)
    got = U.kept_texts(edge_docs, found).collect()
    assert len(got) == edge_docs.count()
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r)
    assert [r.kept_text for r in by_id[5]] == ["same text of a repeated row"] * 2  # one occurrence
    assert by_id[1][0].kept_text is None and by_id[2][0].kept_text == ""
    assert sorted(r.kept_text for r in by_id[6]) == ["one id", "two texts"]
    assert U.removed_units(no_docs).count() == 0


def brute_windows(rows):
    """As brute(), for windows: they may overlap one another, but not their own earliest occurrence."""
    first, out = {}, {}
    for doc_id, text in sorted(rows):
        spans, reach = [], 0
        found = [(s, e) for s, e, u in sorted(U.units_of(text or "", windows=True))
                 if (f := first.setdefault(u, (doc_id, s, e))) != (doc_id, s, e) and not (f[0] == doc_id and s < f[2])]
        for s, e in sorted(found, key=lambda s: (s[0], -s[1])):
            if e > reach:
                spans.append((max(s, reach), e))
                reach = e
        kept, at = "", 0
        for s, e in spans:
            kept, at = kept + text[at:s], e
        out[doc_id] = (spans, kept + (text or "")[at:])
    return out


def test_windows_equal_brute_force(llm_docs):
    rows, df = llm_docs
    assert result(df, windows=True) == brute_windows(rows)
    assert result(df.unionByName(df), windows=True) == brute_windows(rows)


def test_short_sentences_and_cuts_within_a_sentence(spark):
    short = " ".join(f"Item {i} is short." for i in range(20))
    cut = "the first part of it is here, the second part follows, then a third one comes, and it ends with this part"
    rows = [
        (1, f"Own start of one. {short} Own end."), (2, f"Another begin here. {short} Another end."),
        (3, f"Somebody wrote that {cut}, as they say."), (4, f"It is said, {cut}, or so."), (5, "Item 3 is short. Not the rest."),
    ]
    got = result(spark.createDataFrame(rows, "doc_id long, text string"), windows=True)
    assert got[1][0] == [] and got[3][0] == [] and got[5][0] == []
    assert sum(e - s for s, e in got[2][0]) > 0.9 * len(short) and "Another begin here." in got[2][1]
    assert sum(e - s for s, e in got[4][0]) > 0.6 * len(cut) and got[4][1].startswith("It is said,")


def plain_parts(text, start, end, marks):
    """Parts of text[start:end]: cut behind a run of marks that white space or the end follows, white space before a part left out."""
    out, at = [], start
    while at < end:
        while at < end and text[at].isspace():
            at += 1
        if at == end:
            break
        begin = at
        at += 1
        while at < end:
            if text[at - 1] in marks and at - 1 > begin and (text[at].isspace()):
                break
            at += 1
        out.append((begin, at))
    return out


def test_clause_units_by_a_plain_splitter(spark):
    """Units of simple texts (single marks, no blank ends) by a splitter of its own."""
    rnd = __import__("random").Random(4)
    for _ in range(60):
        text = " ".join(rnd.choice("a bb ccc dd, e. f; gg! h? i:".split()) for _ in range(rnd.randrange(1, 60)))
        sentences = plain_parts(text, 0, len(text), ".!?")
        clauses = [c for a, b in sentences for c in plain_parts(text, a, b, ",;:")]
        size = [len(text[a:b].split()) for a, b in clauses]
        want = {(0, len(text))}
        if len(sentences) > 1:
            want |= {(a, b) for a, b in sentences if len(text[a:b].split()) >= 8}
        for i in range(len(clauses)):
            right = next((j for j in range(i, len(clauses)) if sum(size[i:j + 1]) >= 8), None)
            left = next((j for j in range(i, -1, -1) if sum(size[j:i + 1]) >= 8), None)
            want |= {(clauses[i][0], clauses[right][1])} if right is not None else set()
            want |= {(clauses[left][0], clauses[i][1])} if left is not None else set()
        assert {(a, b) for a, b, _ in U.units_of(text, windows=True)} == want, text


def test_edge_rows_with_windows(edge_docs, no_docs):
    rows = edge_docs.select("doc_id", "text").collect()
    got = U.kept_texts(edge_docs, U.removed_units(edge_docs, windows=True)).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(((r.doc_id, r.text) for r in rows), key=str)
    assert [r.kept_text for r in got if r.doc_id == 5] == ["same text of a repeated row"] * 2
    assert U.removed_units(no_docs, windows=True).count() == 0
