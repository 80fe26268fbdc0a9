"""License scan: base phrases against a plain re-count, templates against their markup."""

import random
import re

import pytest

from trawl.llm import licenses as L


def plain(text):
    lowered = re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    hits = [(i, lab) for p, lab in L.PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in hits]
    return len(words), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def test_base_matches_plain_counts():
    rng = random.Random(4)
    words = ["cc", "by", "CC", "mit", "MIT", "license", "License", "apache", "gnu", "general", "public", "é", "x", "cc_by", "İ", "K"]
    for _ in range(600):
        text = "".join(rng.choice(words) + rng.choice([" ", "-", "\n", ".", "", "\x7f"]) for _ in range(rng.randint(0, 40)))
        assert L.scan_text(text)[:5] == plain(text), text


def labels(text):
    return L.scan_text(text)[5].split(",")


def test_templates():
    assert labels("Licensed under the Apache License, Version 2.0.") == ["apache", "apache-2.0"]
    assert labels("licensed UNDER the apache license 2.0") == ["apache", "apache-2.0"]
    assert labels("Licensed under an Apache License, Version 2.0.") == ["apache"]
    assert labels("This work is licensed under the GNU General Public License, version 3.") == ["gpl", "gpl-3.0"]
    assert labels("GNU General Public License as published by the Free Software Foundation, either version 2 of the License") == ["gpl", "gpl-2.0"]
    assert labels("Licensed under CC BY-NC 4.0.") == ["cc-by", "cc-by-nc-4.0"]
    full = re.sub(r"<<beginOptional>>.*?<<endOptional>>", "", L.TEMPLATES["mit-text"], flags=re.S)
    mit = re.sub(r"<<var.*?>>", "Jane Doe and others", full)
    assert "mit-text" in labels("intro words " + mit + " and more") and L.scan_text(mit)[6] == 1.0
    broken = mit.replace("without restriction", "with restriction")
    assert "mit-text" not in labels(broken) and 0 < L.scan_text(broken)[6] < 1


def test_random_templates_match_a_regular_expression():
    rng = random.Random(9)
    for _ in range(300):
        parts, pattern = [], ""
        for i in range(rng.randint(1, 5)):
            w = rng.choice("abc") if i else "z"
            kind = rng.random() if i else 1
            if kind < 0.3:
                parts.append(f"<<beginOptional>>{w} {w}<<endOptional>>")
                pattern += f"(?:{w} {w} )?"
            elif kind < 0.5:
                parts.append("<<var;words=2>>")
                pattern += r"(?:\w ){0,2}"
            else:
                parts.append(w)
                pattern += f"{w} "
        a = L.compile_template("t", " ".join(parts))
        text = "".join(rng.choice("zabc") + " " for _ in range(12))
        want = re.search(r"(?:^| )" + pattern, text) is not None
        got = L.scan_text(text, (), (("t", " ".join(parts)),))
        assert (got[5] == "t") == want, (parts, text, a)


def test_rows(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "MIT License " * 20000, "a"), (3, "x", "b"), (None, "cc by cc by", "b")], "doc_id long, text string, labels string")
    got = {(r.doc_id, r.n_base, r.first_word, r.last_word, r.labels) for r in L.scan(df).collect()}
    assert got == {(1, 0, None, None, ""), (2, 0, None, None, ""), (3, 20000, 0, 39998, "mit"), (3, 0, None, None, ""), (None, 2, 0, 2, "cc-by")}
    assert L.scan(df.limit(0)).count() == 0


@pytest.mark.parametrize("label", sorted(L.TEMPLATES))
def test_every_template_accepts_its_wording_and_no_other(label):
    """With and without its optional regions, with fewer and more words in the replaceable ones; not with one mandatory word changed."""
    template = L.TEMPLATES[label]
    full = re.sub(r"<<(begin|end)Optional>>", "", template)
    bare = re.sub(r"<<beginOptional>>.*?<<endOptional>>", "", template, flags=re.S)
    for text in (full, bare):
        for words in (0, 2):
            filled = re.sub(r"<<var;words=\d+>>", " any" * words, text)
            assert label in L.scan_text(f"Before. {filled.upper()}. After")[5].split(",")
    mandatory = re.sub(r"<<var;words=\d+>>", " ", bare).split()
    for k in (0, len(mandatory) // 2, len(mandatory) - 1):
        changed = " ".join([*mandatory[:k], "otherword", *mandatory[k + 1 :]])
        assert label not in L.scan_text(changed)[5].split(",")
    many = int((re.findall(r"<<var;words=(\d+)>>", template) or [0])[-1])
    if many and not template.rstrip().endswith(">>"):
        assert label not in L.scan_text(re.sub(r"<<var;words=\d+>>", " any" * (many + 50), full))[5].split(",")
