"""Python functions against small fixtures and invariants."""

from __future__ import annotations

import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkwell.functions import definitions, latex, meaning, phrases
from inkwell.operators.meanings import meaning_of
from inkwell.sources import html


@pytest.mark.parametrize(
    ("source", "expected"),
    [
        (r"H_{Lambda}=\omega_{c}a^{\dagger}a+\hat{Q}+i+j+\text{noise}", ["H_Lambda", "omega_c", "a", "Q_hat"]),
        (r"F_{1}^{\prime}+V_{A_{1}A_{2}}", ["F_1_prime", "V_A_1_A_2"]),
        (r"\ddot{u}_{n}+q^{L}+x^2", ["u_n_double_dot", "q_sup_L", "x"]),
        (r"H=\omega_c a", ["H", "omega_c", "a"]),
        ("", []),
    ],
)
def test_scan_symbols(source, expected):
    assert [s["canonical"] for s in latex.scan_symbols(source)] == expected


def test_scan_gives_aliases_and_forms():
    found = latex.scan_symbols(r"\omega_{c}")[0]
    assert "ω_c" in found["aliases"] and found["latex_forms"] == [r"\omega_{c}"]


def test_parse_symbol():
    parsed = latex.parse_symbol(["u^{L}_{n}"], "u")
    assert (parsed["base"], parsed["subscript"], parsed["superscript"]) == ("u", "n", "L")
    assert latex.canonical_latex("u^{L}_{n}") == "u^L_n"
    assert latex.parse_symbol([r"\vec{\hat{x}}_2"], "x")["decorators"] == ["vec", "hat"]


def test_mathml_before_latex():
    got = latex.markup_symbols(["<math><msub><mi>ω</mi><mi>c</mi></msub><mi>i</mi><msup><mi>x</mi><mn>2</mn></msup></math>"], r"\alpha")
    assert [s["canonical"] for s in got] == ["omega_c", "x"]
    assert [s["canonical"] for s in latex.markup_symbols(["<math><mn>1</mn></math>"], r"\alpha_1")] == ["alpha_1"]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="\\{}_^ abαω'hat1", max_size=40))
def test_scanners_never_fail(s):
    latex.scan_symbols(s)
    latex.latex_symbols(s)
    latex.parse_symbol([s], s)


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("The covariance matrix of the TMSV state can be written as", "covariance matrix of the TMSV state"),
        ("We simplify this expression to derive the dispersion relation.", "dispersion relation"),
        ("In some circles, the time interval is called the correlation hole.", "correlation hole"),
        ("where p is the momentum of the particle", ""),
        (r"The unitary evolution operator of \hat{H}_{2} can be represented as", r"unitary evolution operator of \hat{H}_{2}"),
        (r"\rho=\sum_i p_i", ""),
        ("Taking into account the plasma dispersion relation, we expand the field", "plasma dispersion relation"),
        ("", ""),
    ],
)
def test_phrases(text, expected):
    assert phrases.clean(text)["meaning"] == expected


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("the energy matrix of we derive is given by state , . ( ) where called density".split()), max_size=25))
def test_phrases_are_verbatim_and_stable(pieces):
    text = " ".join(pieces)
    first = phrases.postprocess(text, None, text)
    assert first["meaning"] in text
    again = phrases.postprocess(first["meaning"], None, text, first)
    assert again["meaning"] == first["meaning"]


def test_flagged_records_keep_their_meaning():
    got = phrases.postprocess("where p is the momentum of it", None, "where p is the momentum of it")
    assert got["flagged"] and not got["applied"] and got["meaning"].startswith("where p")


OMEGA = ("omega", "\\omega", "ω")


@pytest.mark.parametrize(
    ("text", "aliases", "expected"),
    [
        (r"Here, \omega denotes the angular frequency of the mode.", OMEGA, ("angular frequency of the mode", "symbol_before_cue")),
        (r"Here, \omega is the angular frequency of the mode.", OMEGA, ("angular frequency of the mode", "contextual_copula")),
        ("We denote the displacement of the atom on the left side as u^{L}_{n}.", ("u^{L}_{n}",), ("displacement of the atom on the left side", "definition_before_symbol")),
        (r"Here, c is the speed of light, and \varepsilon_0 is the permittivity", ("c",), ("speed of light", "contextual_copula")),
        (r"We substitute \omega into the expression", OMEGA, ("", "no_pattern")),
        ("time t is discretized into steps", ("t",), ("", "no_pattern")),
        ("where R is a probability mass function p(r(t.", ("R",), ("", "no_pattern")),
        ("m is the mass of it", ("m",), ("mass of it", "initial_copula")),
        ("anything", (), ("", "no_pattern")),
    ],
)
def test_define_by_cue(text, aliases, expected):
    assert definitions.define_by_cue(text, aliases)[:2] == expected


def test_second_generation_cues():
    assert definitions.define_by_cue("let k be the wave number", ("k",), definitions.CUE_PATTERNS_2)[:2] == ("wave number", "let_be")


def test_define_by_span():
    assert definitions.define_by_span(r"where \omega is the angular frequency of the mode. Next", OMEGA) == ("the angular frequency of the mode", "where_is", 1.0)
    others = [("a",), ("b",)]
    assert definitions.define_by_span("a and b are the lattice constant and band gap, respectively", ("b",), "", others) == ("band gap", "respectively", 0.75)
    found = definitions.find_definition(["nothing here", "let g be the coupling constant of it"], ("g",))
    assert found[1:] == ("let_be", 0.8, 1)


def test_references():
    got = html.references("See Eq. (2), Eqs. (3, 4), and Equations (5)-(7), but not bare (8).")
    assert [(r["reference_type"], r["targets"]) for r in got] == [("singular", ["2"]), ("list", ["3", "4"]), ("range", ["5", "6", "7"])]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB. ?!\n\u00a0(1", max_size=60))
def test_sentence_offsets(text):
    for s, a, b in html.sentence_spans(text):
        assert text[a:b] == s == s.strip()


def test_meanings_by_score():
    near = {"chunk_id": "p:equation_neighborhood:3", "score": 2.0, "nearby_equation_ids": ["3"], "text": "Section: Model\nTherefore, the effective system Hamiltonian can be written as\nEquation (3): H=x\nIt is large."}
    got = meaning_of("3", "", [near])
    assert (got["meaning"], got["strategy"]) == ("the effective system Hamiltonian", "anchor_subject")
    far = {"chunk_id": "p:sentence:1", "score": 1.0, "text": "The experiment was repeated yesterday."}
    assert meaning_of("3", "", [far])["meaning"] == ""
    kept = meaning_of("3", "", [far], lambda e, q, c: [0.9] * len(c))
    assert kept["selection"] == "mathbert_fallback" and kept["confidence"] < 6 and kept["meaning"]
    with pytest.raises(ValueError):
        meaning_of("3", "", [far], lambda e, q, c: [])
    after = {"chunk_id": "p:sentence:2", "score": 1.0, "text": "Equation (3): H=x\nWe use it to derive the dispersion relation."}
    assert meaning_of("3", "", [after])["meaning"] == "the dispersion relation"
    assert meaning.extract_span("Eq. (3) describes the energy of it.", "3", "retrieved") == ("the energy of it", "explicit_description")


def test_phrases_of_long_texts_take_linear_time():
    began = time.process_time()
    assert phrases.clean("state of words without marks " * 20_000)["strategy"] == "science_head_window"
    assert time.process_time() - began < 4  # 7 seconds if every place is tried as the beginning of a phrase


def test_places_where_phrases_end_give_the_matches_of_the_whole_pattern():
    rng = random.Random(3)
    words = "the a Our energy state x is are can be written given takes has the form , ; : . 1 \\omega ſ é".split()
    for n in range(2000):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(1, 70))).replace("energy", "e" * rng.randint(1, 190)).replace(" ", "  " if n % 9 == 0 else " ", 3)
        for strategy, _, pattern in phrases.TEMPLATES:
            assert [m.span() for m in phrases.matches(strategy, pattern, text)] == [m.span() for m in pattern.finditer(text)]


def test_references_are_found_over_arrow_arrays_of_any_length(spark):
    import inspect

    texts = [None if k % 50 == 7 else f"See Eq. ({k}) and Eqs. (1)-(3)." for k in range(200)]
    rows = [(k, "s", "p", "x", 0, 0, t) for k, t in enumerate(texts)]
    sents = spark.createDataFrame(rows, "paper_id int, section_id string, paragraph_id string, sentence_id string, document_order int, order int, text string").coalesce(1)
    got = sorted((r["paper_id"], r["reference_id"], r["reference_type"], tuple(r["targets"])) for r in html.cross_references(sents).collect())
    want = [x for k, t in enumerate(texts) if t for x in ((k, f"{k}:xref:1", "singular", (str(k),)), (k, f"{k}:xref:2", "range", ("1", "2", "3")))]
    assert got == want
    assert "pandas_udf" not in inspect.getsource(html.cross_references)
    assert html.cross_references(sents.limit(0)).count() == 0
