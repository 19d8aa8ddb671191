import random
import re

import pytest
from pyspark.sql import functions as F

from censora.llm import pii


def brute(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        total = sum(sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(reversed(digits)))
        if 16 <= len(digits) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub(r"\D", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_base_spans_are_those_of_the_patterns():
    pick = random.Random(2)
    for k in range(20_000):
        text = "".join(pick.choice("ab.@-+0199 ()25é" if k % 2 else "a.@-b@.") for _ in range(pick.randint(0, 60)))
        assert [s[:3] for s in pii.spans(text) if s.base] == brute(text), text


@pytest.mark.parametrize(
    "text, kind, span",
    [
        ("write john.doe [at] example [dot] com now", "email", "john.doe [at] example [dot] com"),
        ("john dot doe at mail dot example dot com, ok", "email", "john dot doe at mail dot example dot com"),
        ("user (at) host.org", "email", "user (at) host.org"),
        ("user @ host.com", "email", "user @ host.com"),
        ("name{at}site{dot}co{dot}uk", "email", "name{at}site{dot}co{dot}uk"),
        ("see hsr.29 at mail5.example.com!", "email", "hsr.29 at mail5.example.com"),
        ("x jоhn@exаmple.com y", "email", "jоhn@exаmple.com"),
        ("a​bc@ex​ample.org", "email", "a​bc@ex​ample.org"),
        ("card ４１１１ １１１１ １１１１ １１１１.", "card", "４１１１ １１１１ １１１１ １１１１"),
        ("say four one one one one one one one one one one one one one one one", "card", "four" + " one" * 15),
        ("call plus one five five five one two three four five six seven please", "phone", "plus one five five five one two three four five six seven"),
        ("call + 1 five five five 123 4567", "phone", "+ 1 five five five 123 4567"),
        ("ip one nine two dot one six eight dot one dot one zero", "ip", "one nine two dot one six eight dot one dot one zero"),
        ("١٩٢.١٦٨.١.١", "ip", "١٩٢.١٦٨.١.١"),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, span):
    added = [(s.kind, text[s.start : s.end]) for s in pii.spans(text) if not s.base]
    assert added == [(kind, span)]
    assert pii.masked(text) == text.replace(span, f"<{kind.upper()}>")


@pytest.mark.parametrize("text", ["look at the dot of it", "he is one two three four", "meet at example.com", "one at a time, two at most", "the point at issue", "", "a@b", "1.2.3.4.", "version 1.2.3"])
def test_clean_text_is_left_alone(text):
    assert [s for s in pii.spans(text) if not s.base] == []


def test_a_wider_disguised_span_joins_the_base_one():
    text = "jоhn@example.com"
    assert [(s.start, s.end, s.base) for s in pii.spans(text)] == [(0, 16, False), (2, 16, True)]
    assert pii.masked(text) == "<EMAIL>"


def test_awkward_rows(clashing):
    got = {(r["doc_id"], len(r["spans"])) for r in pii.find(clashing).collect()}
    assert got == {(i, 0) for i in (1, 2, 3, 4, 5, 6, None, 8, 9, 10)}
    masked = pii.mask(clashing)
    assert masked.columns == clashing.columns
    assert sorted(map(str, masked.collect())) == sorted(map(str, clashing.collect()))
    assert pii.find(clashing.limit(0)).collect() == []


def test_joined_spans(spark):
    docs = spark.createDataFrame([(1, "a@b.c then 10.0.0.1 and x@y.zz"), (2, None)], "doc_id long, text string")
    got = dict(pii.find(docs).select("doc_id", pii.joined(F.col("spans"))).collect())
    assert got == {1: "email:0:5,email:24:30,ip:11:19", 2: ""}


def test_very_long_texts():
    text = "1 " * 200_000 + "a@b.c" + "+1" + " " * 200_000
    assert [s[0] for s in pii.spans(text)] == ["email"]


@pytest.mark.parametrize(
    "text, kind, span",
    [
        ("host 192 dot 168 dot 1 dot 1 here", "ip", "192 dot 168 dot 1 dot 1"),
        ("host 10 dot zero dot 0 dot one here", "ip", "10 dot zero dot 0 dot one"),
        ("host 192.168.one.1 here", "ip", "192.168.one.1"),
        ("call +1 555 123 45 six seven now", "phone", "+1 555 123 45 six seven"),
        ("call plus 1 555 123 4567 now", "phone", "plus 1 555 123 4567"),
        ("card 4111 1111 1111 111 one here", "card", "4111 1111 1111 111 one"),
        ("card 41111111 one 1111 one 11 here", "card", "41111111 one 1111 one 11"),
        ("card 4111 dash 1111 dash 1111 dash 1111 here", "card", "4111 dash 1111 dash 1111 dash 1111"),
        ("to maria dot lopez at correo dot mx, please", "email", "maria dot lopez at correo dot mx"),
        ("to ana at mail dot empresa dot travel now", "email", "ana at mail dot empresa dot travel"),
    ],
)
def test_few_spoken_words_are_enough(text, kind, span):
    assert [(s.kind, text[s.start : s.end]) for s in pii.spans(text) if not s.base] == [(kind, span)]
    assert pii.masked(text) == text.replace(span, f"<{kind.upper()}>")


@pytest.mark.parametrize("text", ["at 300 dot 168 dot 1 dot 1", "3 point 5 plus one", "4111 1111 1111 111 two", "we look at one dot or the other", "pages 10 dash 20, one each"])
def test_few_spoken_words_without_an_identifier(text):
    assert pii.spans(text) == []


@pytest.mark.parametrize(
    "text, kind, span",
    [
        ("tel:plus-one-five-five-five-one-two-three-four", "phone", "plus-one-five-five-five-one-two-three-four"),
        ('"four' + "-one" * 15 + '"', "card", "four" + "-one" * 15),
        ("card\tfour" + "\tone" * 15 + "\nend", "card", "four" + "\tone" * 15),
        ("[one) dot (two) dot (three) dot (four]", "ip", "one) dot (two) dot (three) dot (four"),
    ],
)
def test_runs_are_found_whatever_stands_around_them(text, kind, span):
    """The result does not depend on other runs in the text."""
    for whole in (text, f"{text}\nlist one two three end"):
        assert [(s.kind, whole[s.start : s.end]) for s in pii.spans(whole) if not s.base] == [(kind, span)]
