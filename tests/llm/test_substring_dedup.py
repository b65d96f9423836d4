import random

from llm_samples import prose

from spark_trials.llm import substring_dedup as sub


def cut(text):
    """Sentences letter by letter, without patterns: (start, end) with the blanks that follow."""

    def pieces(lo, hi, border):
        out, at, k = [], lo, lo
        while k < hi:
            stop = border(k, lo, hi)
            if stop:
                out, at, k = [*out, (at, stop)], stop, stop
            else:
                k += 1
        return [*out, (at, hi)] if at < hi else out

    def run(k, hi, lines):
        while k < hi and text[k].isspace() and (lines or text[k] != "\n"):
            k += 1
        return k

    def ends(k, lo, hi):
        if text[k] == "\n":
            return run(k, hi, True)
        return run(k, hi, False) if k and text[k - 1] in ".!?" and text[k].isspace() else 0

    def clause(k, lo, hi):
        if k and text[k - 1] in ",;:" and text[k].isspace() and text[k] != "\n":
            return run(k, hi, False)
        great = k + 1 < hi and text[k + 1] != "×" and ("A" <= text[k + 1] <= "Z" or "À" <= text[k + 1] <= "Þ")
        return k + 1 if great and text[k].isspace() and text[k] != "\n" else 0

    out = []
    for a, b in pieces(0, len(text), ends):
        out += pieces(a, b, clause) if len(text[a:b].split()) > sub.LONG else [(a, b)]
    return [(a, b) for a, b in out if text[a:b].strip()]


def runs(sizes, words, least):
    """(from, to) of the shortest runs that begin, or end, at each place, by trying."""

    def enough(k, j):
        return j - k >= least and sum(sizes[k:j]) >= words

    out = set()
    for at in range(len(sizes) + 1):
        k = j = at
        while j < len(sizes) and not enough(at, j):
            j += 1
        while k > 0 and not enough(k, at):
            k -= 1
        out |= {(a, b) for a, b in ((at, j), (k, at)) if enough(a, b)}
    return sorted(out)


def plain(rows, words=sub.WORDS, least=sub.SENTENCES):
    """All runs of all texts by their words; every run but the first takes its sentences away."""
    docs = sorted({(i, t) for i, t in rows if t is not None}, key=lambda r: (r[0] is not None, r[0] or 0))
    seen, gone = set(), {d: set() for d in docs}
    for d in docs:
        own = [d[1][a:b].lower().split() for a, b in cut(d[1])]
        for k, j in runs([len(s) for s in own], words, least):
            run = tuple(tuple(s) for s in own[k:j])
            if run in seen:
                gone[d] |= set(range(k, j))
            seen.add(run)
    out = {}
    for d in docs:
        text, at = "", 0
        for k, (a, b) in enumerate(cut(d[1])):
            text += d[1][at:a] + ("" if k in gone[d] else d[1][a:b])
            at = b
        out[d] = (text + d[1][at:], len(cut(d[1])), len(gone[d]))
    return out


def test_sentences_against_plain_cuts():
    rng = random.Random(3)
    bits = ["a", "B", "word", "Ärger", "×x", ".", ",", ";", ":", "!", "?", "\n", " ", "  ", "\t", "\u00a0", "Öl", "e.g."]
    for _ in range(600):
        text = "".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randint(0, 120)))
        assert sub.sentences(text) == cut(text), repr(text)


def test_against_plain_search(spark, docs, docs_rows):
    rng = random.Random(9)
    passage = prose(rng, 60)
    rows = [(r[0], r[1]) for r in docs_rows] + [(200 + k, f"{prose(rng, 30)} {passage} {prose(rng, 25)}") for k in range(6)]
    rows += [(300, "Same line here.\n" * 40), (301, passage.upper()), (302, f"{passage}\n{passage}")]
    df = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], "doc_id long, text string, span string, `__cuts` string, n_removed int").repartition(7)
    want = plain(rows)
    out = sub.dedup(df)
    assert out.columns == ["doc_id", "text", "span", "__cuts", "n_sentences", "n_removed"]
    got = out.collect()
    assert len(got) == len(rows)
    # rows that repeat an id and a text get the same result; order says which text each had
    expected = sorted(((i, *(want[(i, t)] if t is not None else (None, 0, 0))) for i, t in rows), key=str)
    assert sorted(((r["doc_id"], r["text"], r["n_sentences"], r["n_removed"]) for r in got), key=str) == expected
    kept = sub.cleaned(df)
    assert kept.columns == df.columns and {r["n_removed"] for r in kept.collect()} == {1}
    assert sorted((r["doc_id"], r["text"]) for r in kept.where("doc_id >= 200").collect()) == sorted((r["doc_id"], r["text"]) for r in got if (r["doc_id"] or 0) >= 200)
    texts = {r["doc_id"]: r["text"] for r in got}
    body = " ".join(passage.split()[25:-25])
    assert sum(body in (texts[200 + k] or "") for k in range(6)) == 1
    assert texts[200].split() and body in texts[200]


def test_clean_documents_stay(spark):
    rng = random.Random(11)
    rows = [(k, prose(rng, 200)) for k in range(40)]
    out = sub.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["text"]) for r in out} == set(rows) and all(r["n_removed"] == 0 for r in out)


def test_spans_are_positions_free(no_docs):
    text = "One two three four five six. Seven eight nine ten eleven twelve thirteen. Fourteen fifteen sixteen seventeen eighteen nineteen twenty twentyone."
    a, b = sub.spans(text), sub.spans("Something else before it. " + text)
    assert len(a[2]) == 1 and a[2][0] in b[2]
    assert len(sub.spans("one two. " + "three " * 25, least=1)[0]) == 2 and len(sub.spans("one two. " + "three " * 25)[0]) == 1
    assert sub.dedup(no_docs).count() == 0
    assert "".join(text[x:y] for x, y in sub.sentences(text)) == text


def test_ends_of_passages_and_clauses(spark):
    """A passage goes whole, its last short sentence included; one that is a single long sentence goes by its clauses."""
    rng = random.Random(5)
    passage = f"{prose(rng, 12)} end. {prose(rng, 14)} end. {prose(rng, 6)} end."
    long = ", ".join(prose(rng, 9).lower().replace(".", "").replace(",", "") for _ in range(7))
    rows = [(k, f"{prose(rng, 30)} end. {passage} {prose(rng, 30)}") for k in range(3)] + [(10 + k, f"{prose(rng, 8)} and {long}, {prose(rng, 15)}") for k in range(3)]
    got = {r["doc_id"]: r["text"] for r in sub.cleaned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [passage in got[k] for k in range(3)] == [True, False, False]
    last = passage.split(" end. ")[2]
    assert last in got[0] and last not in got[1] and last not in got[2]
    inner = ", ".join(long.split(", ")[1:])
    assert inner in got[10] and all(clause not in got[k] for k in (11, 12) for clause in inner.split(", "))


def test_places_are_merged(spark):
    """A copy of a whole document is one place, not one for each of its spans."""
    rng = random.Random(6)
    text = " ".join(f"{prose(rng, 11)} end." for _ in range(40))
    rows = sub.repeated(spark.createDataFrame([(1, text), (2, f"{text} "), (3, prose(rng, 90))], "doc_id long, text string")).collect()
    assert [(r["id"], r["cuts"]) for r in rows] == [(2, [len(sub.sentences(text))])]
