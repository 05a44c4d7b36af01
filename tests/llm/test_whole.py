"""Corpus operators where a border or a malformed input once lost part of the work."""

import random

from cellscope.llm import fingerprints, html_text


def test_near_copies_around_the_short_length_are_alike():
    rnd = random.Random(3)
    for _ in range(20):
        text = "".join(rnd.choice("abcdefghij klmno") for _ in range(265))
        a, b = fingerprints.fingerprints([text, text[:248]])
        assert fingerprints.likeness(a[None], b[None])[0] > 0.8


def test_scripts_and_unclosed_elements_do_not_swallow_the_page():
    tree = html_text.train()
    text = lambda page: html_text.main_text(page, tree)
    for silent in (
        "<script>for(i=0;i<n;i++){x()}</script>", "<SCRIPT>a<!--b</Script >", "<style>a<b{}</style>", "<script>s='<p>no</p></button>'</script>", "<svg><title>a<b</title><path/></svg>",
        "<object>a<object>b</object>c</object>", "<button>a</button>", "<script src=x></script>",
    ):
        assert text(f"<div>{silent}</div><article><p>kept text</p></article><div><button>z</button></div>") == "kept text", silent
    for tag in ("button", "select", "object", "video", "audio", "canvas", "svg", "noscript"):
        assert text(f"<div><{tag}></div><article><p>kept text</p></article>") == "kept text"
        assert text(f"<div><{tag}></div><article><p>kept text</p></article><div><{tag}>z</{tag}></div>") == "kept text"
    assert text("<article><p>kept text</p></article><script>cut <p>off") == "kept text"
