"""Registered domains under suffixes of two labels, and languages that meta tags declare."""

import pytest

from wareflow.llm.language import address, declared


@pytest.mark.parametrize(
    "url, domain",
    [
        ("http://www.shop.co.uk/x", "shop.co.uk"),
        ("https://a.b.loja.com.br", "loja.com.br"),
        ("https://someone.github.io/page", "someone.github.io"),
        ("https://www.example.com/", "example.com"),
        ("http://co.uk/", "co.uk"),
        ("http://t.co/abc", "t.co"),
        ("http://news.site.de", "site.de"),
        ("http://192.0.2.7:80/", "192.0.2.7"),
        (None, ""),
    ],
)
def test_registered_domain(url, domain):
    assert address(url)[1] == domain


@pytest.mark.parametrize(
    "html, lang",
    [
        (b'<html><head><meta http-equiv="Content-Language" content="pt-BR"></head>', "pt"),
        (b"<meta content='de' http-equiv='content-language'/>", "de"),
        (b"<META HTTP-EQUIV=content-language CONTENT=fr>", "fr"),
        (b'<meta http-equiv="content-language" content="es, en">', "es"),
        (b'<html lang="en"><meta http-equiv="content-language" content="pt">', "en"),
        (b'<meta http-equiv="content-type" content="text/html">', None),
        (b'<meta name="description" content="de"><p>http-equiv="content-language"', None),
    ],
)
def test_declared(html, lang):
    assert declared(html) == lang
