from passages.llm.licences import TEMPLATES, bigrams, licences, windows, words


def test_templates_notices_and_paragraphs(docs_of):
    wrapped = TEMPLATES["mit-text"].replace(". ", ".\n")
    rows = [
        (1, "Some words here.\nReleased under the MIT License.\nMore."),
        (2, f"Title line\n\n{wrapped}\n\nLast line"),
        (3, "Nothing of the kind, the license of poets"),
        (4, None),
        (5, ""),
        (6, TEMPLATES["gpl-3.0-header"].upper()),
        (6, TEMPLATES["gpl-3.0-header"].upper()),
        (7, "released under the mit license"),
    ]
    found = sorted((r["id"], r["line"], r["n_lines"], r["licence"], r["dice"]) for r in licences(docs_of(rows)).collect())
    assert [f[:4] for f in found] == [
        (1, 1, 1, "mit"),
        (2, 0, wrapped.count("\n") + 5, "mit-text"),
        (2, 2, wrapped.count("\n") + 1, "mit-text"),
        (6, 0, 1, "gpl-3.0-header"),
        (6, 0, 1, "gpl-3.0-header"),
        (7, 0, 1, "mit"),
    ]
    assert [f[4] == 1 for f in found] == [True, False, True, True, True, True]


def test_against_all_templates(docs_of, random_rows):
    templates = {"a": "the of and to in it", "b": "is on at by an er th", "c": "the of and"}
    known = {k: bigrams(words(v)) for k, v in templates.items()}
    wanted = []
    for doc_id, text, *_ in random_rows:
        own = bigrams(words(text))
        scored = [(2 * len(own & t) / (len(own) + len(t)), k) for k, t in known.items() if own]
        best = max(scored, key=lambda x: (x[0], -ord(x[1])), default=(0, ""))
        if best[0] >= 0.15:
            wanted.append((doc_id, best[1], round(best[0], 9)))
    found = licences(docs_of(random_rows), templates=templates, similarity=0.15).collect()
    assert sorted((r["id"], r["licence"], round(r["dice"], 9)) for r in found) == sorted(wanted)
    assert wanted


def test_odd_rows_and_empty_table(docs_of, odd_rows):
    assert licences(docs_of(odd_rows)).collect() == []
    assert licences(docs_of([])).collect() == []


def test_licences_with_empty_lines_and_notices_in_sentences(docs_of):
    mit = TEMPLATES["mit-text"].replace("conditions: The", "conditions:\n\nThe").replace("Software. THE", "Software.\n\nTHE")
    gpl = TEMPLATES["gpl-3.0-header"].replace(". ", ".\n\n").replace(" the ", "\nthe ")
    bsd = TEMPLATES["bsd-2-clause"].replace(" 1. ", "\n\n1. ").replace(" 2. ", "\n\n2. ").replace(" THIS", "\n\nTHIS")
    prose = "\n\n".join(f"A paragraph {n} about the use of the river and {n} boats in it." for n in range(60))
    rows = [
        (1, f"{prose}\n\n{mit}\n\n{prose}"),
        (2, f"# Copyright\n{gpl}\n\nimport os\n{prose}"),
        (3, f"{prose}\n{bsd}\n{prose}\n\n{mit}\n{prose}"),
        (4, "Copyright (c) 2020 J Doe. Released under the MIT License."),
        (5, f"{prose} This text is licensed under CC BY-NC 4.0, the code is released under the MIT license; enjoy."),
        (6, prose),
        (7, f"A page.\n\nSee: {TEMPLATES['apache-2.0-header']} And so on: {prose}"),
    ]
    found = sorted((r["id"], r["line"], r["n_lines"], r["licence"]) for r in licences(docs_of(rows)).collect())
    lines, last = prose.count("\n") + 1, prose.count("\n")
    after = lines + bsd.count("\n") + 1 + lines + 1
    assert found == [
        (1, lines + 1, mit.count("\n") + 1, "mit-text"),
        (2, 1, gpl.count("\n") + 1, "gpl-3.0-header"),
        (3, lines, bsd.count("\n") + 1, "bsd-2-clause"),
        (3, after, mit.count("\n") + 1, "mit-text"),
        (4, 0, 1, "mit"),
        (5, last, 1, "cc-by-nc-4.0"),
        (5, last, 1, "mit"),
        (7, 2, 1, "apache-2.0-header"),
    ]


def test_windows_are_those_of_all_runs_of_words():
    import random

    draw = random.Random(4)
    known = {k: bigrams(words(v)) for k, v in {"a": "the of and to in it by", "b": "is on at an", "c": "or no"}.items()}
    anything = frozenset(p for t in known.values() for p in t)
    for _ in range(300):
        text = draw.choices(["x", "y"], k=draw.randint(0, 9))
        for _ in range(draw.randint(0, 2)):
            piece = draw.choice(["the of and to in it by", "the of and x to in it by", "is on at an", "or no", "on at an"]).split()
            text += piece[: draw.randint(1, 9)] + draw.choices(["x", "the", "is"], k=draw.randint(0, 4))
        best = 0.0
        for i in range(len(text)):
            for j in range(i + 2, len(text) + 1):
                own = bigrams(text[i:j])
                best = max([best, *(2 * len(own & t) / (len(own) + len(t)) for t in known.values())])
        found = windows(text, known, anything, 0.8)
        assert bool(found) == (best >= 0.8)
        for first, last, name, dice, size in found:
            own = bigrams(text[first : last + 1])
            assert size == len(own) and dice == 2 * len(own & known[name]) / (size + len(known[name])) >= 0.8
