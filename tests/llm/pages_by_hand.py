"""Pages in layouts that are common on the web, labelled by hand: html and blocks of the main text."""

PAGES = [
    # A blog: Bootstrap grid, sidebar, share buttons, comments.
    ("""<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>Growing tomatoes</title><link rel="stylesheet" href="b.css"></head>
<body><div class="navbar navbar-default"><div class="container"><a class="navbar-brand" href="/">The Garden</a><ul class="nav"><li><a href="/a">Home</a></li><li><a href="/b">Archive</a></li></ul></div></div>
<div class="container"><div class="row"><div class="col-md-8"><div class="post-content"><h1>Growing tomatoes</h1>
<p>Tomatoes need sun, water and patience. We planted ours in <b>late April</b>, once the nights were mild.</p>
<p>By June they stood a metre high, and the first yellow flowers had opened.</p><h2>Feeding</h2><p>Feed them once a week &amp; water in the morning, not at noon.</p></div>
<div class="share"><a href="#">Tweet</a> <a href="#">Share</a></div><div id="comments"><h3>2 comments</h3><div class="comment"><p>Lovely, mine never ripen before September.</p></div><div class="comment"><p>Try a sunnier wall.</p></div></div></div>
<div class="col-md-4"><div class="sidebar"><h3>Recent posts</h3><ul><li><a href="/1">Beans</a></li><li><a href="/2">Compost</a></li></ul></div></div></div></div>
<footer><p>&copy; 2019 The Garden. All rights reserved.</p></footer></body></html>""",
     ["Growing tomatoes", "Tomatoes need sun, water and patience. We planted ours in late April, once the nights were mild.", "By June they stood a metre high, and the first yellow flowers had opened.", "Feeding", "Feed them once a week & water in the morning, not at noon."]),
    # News: semantic elements, an advert inside the article, related links, a notice.
    ("""<html><body><div class="cookie-consent"><p>We use cookies to improve our service.</p><button>Accept</button></div><header><a href="/">Daily Post</a><nav><a href="/w">World</a><a href="/s">Sport</a></nav></header>
<main><article><h1>Bridge reopens after two years</h1><p>The old bridge over the river was opened again on Friday, two years after the flood.</p><div class="advert"><p>Buy one, get one free, this week only.</p></div>
<p>Hundreds of people came to walk across it, among them the mayor.</p><ul><li>Length: 210 metres</li><li>Built: 1884</li></ul></article><aside><h2>Related</h2><ul><li><a href="/x">Flood of the century</a></li></ul></aside></main><footer>Contact | Imprint</footer></body></html>""",
     ["Bridge reopens after two years", "The old bridge over the river was opened again on Friday, two years after the flood.", "Hundreds of people came to walk across it, among them the mayor.", "Length: 210 metres", "Built: 1884"]),
    # Documentation: left menu, breadcrumb, code.
    ("""<html><body><div id="header"><span>Project docs</span><form action="/search"><input name="q"><label>Search</label></form></div><div class="menu"><ul><li><a href="1.html">Install</a></li><li><a href="2.html">Configure</a></li><li><a href="3.html">Run</a></li></ul></div>
<div class="content"><h1>Configure</h1><p>All settings are kept in one file. Its format is a list of names and values, one for each line.</p><pre>port = 8080
host = localhost</pre><p>Restart the service when you have changed it.</p></div><div id="footer"><p>Last build on Tuesday.</p></div></body></html>""",
     ["Configure", "All settings are kept in one file. Its format is a list of names and values, one for each line.", "port = 8080 host = localhost", "Restart the service when you have changed it."]),
    # An old page: unclosed paragraphs, upper case, a table of figures.
    ("""<HTML><BODY><DIV CLASS=nav><A HREF=a.html>Back</A> <A HREF=b.html>Next</A></DIV><DIV CLASS="main"><H1>The lighthouse</H1><P>It was built on the cape in 1851, of granite that came by sea.
<P>For ninety years its keepers lit the lamp each evening, and kept a record of every ship.<TABLE><TR><TD>Height</TD><TD>31 m</TD></TR></TABLE></DIV><DIV CLASS=footer>Copyright the society</DIV></BODY></HTML>""",
     ["The lighthouse", "It was built on the cape in 1851, of granite that came by sea.", "For ninety years its keepers lit the lamp each evening, and kept a record of every ship.", "Height", "31 m"]),
    # An encyclopedia: many links within the text, a box of links below.
    ("""<html><body><div id="mw-head"><div class="menu"><a href="/m">Main page</a><a href="/r">Random page</a></div></div><div id="content"><h1>Heron</h1><div id="bodyContent"><p>Herons are <a href="/b">birds</a> of the family <a href="/f">Ardeidae</a>, with sixty-four <a href="/s">species</a>.</p><p>Most of them live by <a href="/w">water</a> and eat fish, frogs and insects.</p></div></div>
<div class="navbox"><div class="nav"><ul><li><a href="/1">Egret</a></li><li><a href="/2">Bittern</a></li><li><a href="/3">Stork</a></li></ul></div></div><footer><p>Text is available under a free licence.</p></footer></body></html>""",
     ["Heron", "Herons are birds of the family Ardeidae, with sixty-four species.", "Most of them live by water and eat fish, frogs and insects."]),
    # A shop's story page: section wrappers, newsletter form, scripts.
    ("""<html><head><script>var a = "<p>no</p>";</script></head><body><div class="topbar"><a href="/">Shop</a> <a href="/cart">Cart (0)</a></div><section class="wrap"><section class="article"><h1>How our mugs are made</h1><p>Every mug starts as a lump of clay on the wheel, and takes four days to dry.</p><blockquote><p>A good handle is felt before it is seen, says the potter.</p></blockquote><p>Glaze comes next; then the kiln, at twelve hundred degrees.</p></section></section>
<div class="newsletter"><form><p>Join our newsletter and get ten per cent off.</p><input type="email"></form></div><div class="footer"><ul><li><a href="/t">Terms</a></li><li><a href="/p">Privacy</a></li></ul></div></body></html>""",
     ["How our mugs are made", "Every mug starts as a lump of clay on the wheel, and takes four days to dry.", "A good handle is felt before it is seen, says the potter.", "Glaze comes next; then the kiln, at twelve hundred degrees."]),
]
