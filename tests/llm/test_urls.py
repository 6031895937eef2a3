"""Links of pages: what is found, and that hostile pages take no more than linear time."""

import time

import pytest

from stopwise.llm import urls


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", (None, None)),
        ('<link rel="canonical" href="http://a.example/x">', ("http://a.example/x", None)),
        ("<LINK HREF=/y REL=canonical><link rel=canonical href=/z>", ("/y", None)),
        ('<link rel="stylesheet" href="/s"><meta http-equiv="refresh" content="0; URL=/new">', (None, "/new")),
        ("<!-- <link rel=canonical href=/no> --><link rel=canonical href=/yes>", ("/yes", None)),
        ("<script>'<link rel=canonical href=/no>'</script><link rel=canonical href=/yes>", ("/yes", None)),
        ('<link title="a > b" rel=canonical href=/q>', ("/q", None)),
        ("<link title='open rel=canonical href=/q>", ("/q", None)),
        ("<!-- open <link rel=canonical href=/no>", (None, None)),
        ("<link rel=canonical href=/cut", (None, None)),
        ("<linked rel=canonical href=/no>", (None, None)),
    ],
)
def test_targets(page, want):
    assert urls.page_targets(page) == want


@pytest.mark.parametrize("part", ["<link ", "<meta ", "<link '", '<meta "', "<!--", "<script>", "<link rel=canonical ", "<link rel ", "<link>", "<meta http-equiv=refresh url", "<style", "rel=canonical"])
def test_a_megabyte_of_hostile_html_takes_no_time(part):
    began = time.time()
    assert urls.page_targets(part * (1_000_000 // len(part))) == (None, None)
    assert time.time() - began < 5
