"""Blocks of pages against a plain walk of the tree that they were written from, and pages of great depth."""

import html
import random
import time

import pytest

from anchorline.llm import htmltext


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("<p>a<!-->b</p>", ["ab"]), ("<p>a<!--->b</p>", ["ab"]), ("<p>a<!-- c --!>b</p>", ["ab"]), ("<p>a<!---->b", ["ab"]), ("<article><p>x</p><!--><p>y</p></article>", ["x", "y"]), ("a<!-- b", ["a"]),
        ("<p>foo <script>x</script>bar</p>", ["foo bar"]), ("<p>a<style>p{}</style>b<p>c", ["ab", "c"]), ("<p>a<template><p>no</template>b", ["ab"]),
        ("&<b></b>lt;", ["&lt;"]), ("a&amp;lt; &copy; c", ["a&lt; © c"]), ("&am<!-- -->p;", ["&amp;"]),
    ],
)
def test_pieces(given, want):
    assert [t for _, t, _ in htmltext.blocks_of(given)] == want


def tree(r, depth):
    """A random element as (tag, attributes, children); children are texts and elements."""
    tag = r.choice(["div", "section", "article", "ul", "b", "i", "a", "span", "script", "style", "!"])
    words = ["one", "two ", " three\n", "&", "<", "é", "  ", "a&b;", "🙂"]
    if tag in ("script", "style", "!"):
        return tag, "", ["no <p> here"]
    inline = tag in ("b", "i", "a", "span")
    children = [r.choice(words) if r.random() < 0.5 or not depth else tree(r, depth - 1) for _ in range(r.randrange(5))]
    if inline:  # elements inside of a block hold no blocks here, as their end tags would be moved
        children = [c for c in children if isinstance(c, str) or c[0] in ("b", "i", "a", "span", "script", "style", "!")]
    return tag, r.choice(["", " class='x y'", ' id="main" data-x=">"']), children


def written(node):
    if isinstance(node, str):
        return html.escape(node)
    tag, attributes, children = node
    if tag == "!":
        return "<!-- no <p> -- > -->"
    if tag in ("script", "style"):
        return f"<{tag}>var x = '<p>no</p>';</{tag}>"
    return f"<{tag}{attributes}>{''.join(map(written, children))}</{tag}>"


def walked(root):
    """Texts of blocks by a plain walk."""
    out, held = [], []

    def close():
        text = " ".join("".join(held).split())
        if text:
            out.append(text)
        held.clear()

    def walk(node):
        if isinstance(node, str):
            held.append(node)
        elif node[0] not in ("script", "style", "!"):
            block = node[0] not in ("b", "i", "a", "span")
            if block:
                close()
            for child in node[2]:
                walk(child)
            if block:
                close()

    walk(root)
    close()
    return out


def test_random_trees():
    r = random.Random(8)
    for _ in range(1500):
        root = ("div", "", [tree(r, 4) for _ in range(4)])
        assert [t for _, t, _ in htmltext.blocks_of(written(root))] == walked(root)


def test_paths_as_words_and_as_buckets():
    path = htmltext.blocks_of("<main class='postBody x'><div id=a><p><b>text")[0][0]
    assert tuple(path) == ("<main", "post", "body", "x", "<div", "a", "<p")
    assert htmltext.path_bits(path) == htmltext.path_bits(tuple(path)) and htmltext.path_bits(()) == htmltext.path_bits(htmltext.Path()) == []


@pytest.mark.parametrize("piece", ["<div>x", "<b>x", "<svg><g>", "<select>", "</span><div class=a>", "<a><p>", "<li><ul>", "<!--a", "<a b='"])
def test_time_in_proportion(piece):
    began = time.process_time()
    htmltext.blocks_of(piece * 100_000)
    assert time.process_time() - began < 8
