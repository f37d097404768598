"""Pages on which one cue alone must not drop words of an article."""

import time

from sparkrag.llm.html_text import main_text

TEXT = "This is the text of a page that has been written for the people who are in it and so on."


def test_names_inside_running_text():
    page = (f"<article><p>In the <span class='search'>search</span> and the <span class=\"alert\">"
            f"alert</span> words of it. <span class='ad'>Buy now</span> {TEXT}</p></article>")
    assert main_text(page) == f"In the search and the alert words of it. {TEXT}"


def test_names_that_only_look_like_a_box():
    page = (f"<article><p>{TEXT}</p><div class='related-work'><p>{TEXT} Work</p></div>"
            f"<div class='related-posts'><p>{TEXT} Posts</p></div></article>")
    assert main_text(page) == f"{TEXT}\n{TEXT} Work"


def test_links_between_running_text():
    links = "<ul><li><a href=x>one</a></li><li><a>two</a></li><li><a>three</a></li></ul>"
    assert main_text(f"<article><p>{TEXT}</p>{links}<p>{TEXT}</p></article>") == \
        f"{TEXT}\none\ntwo\nthree\n{TEXT}"
    assert main_text(f"<article><p>{TEXT}</p>{links}</article>") == TEXT


def test_sign_in_running_text():
    said = "The sign © is the one that is used for the rights of an author and it has been in use."
    assert main_text(f"<div><p>{TEXT}</p><p>{said}</p></div><div>© 2024 Acme Inc</div>") == \
        f"{TEXT}\n{said}"


def test_open_tags_cost_no_walk():
    n = 100_000
    began = time.time()
    for page in ("<div>" * n + TEXT, "<div class=ad><span class=ad>" * n + TEXT,
                 "<article><nav>" * n + TEXT + "</div>" * n, ("<nav><b>y</b></span></p>") * n,
                 "<head><body>" * n + TEXT):
        main_text(page)
    assert time.time() - began < 60
    assert main_text("<div>" * n + f"<p>{TEXT}</p>") == TEXT
