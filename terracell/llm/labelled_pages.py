"""Labelled pages to train the extractor on: blocks under ``data-main="1"`` are main text, ``data-main="0"`` are not.

Written for this purpose; each stands for a common way to lay out a page. The nearest mark above a block counts.
``SINGLE`` are whole pages, ``LAYOUTS`` are filled with the words of each of ``TEXTS``. A layout is the unit to hold out.
"""

SINGLE = (
    """<html><head><title>A walk along the river</title><script>x()</script></head><body data-main="0">
<nav><ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li><li><a href="/about">About</a></li></ul></nav>
<div class="ad">Buy two boots and get the third one free, today only.</div>
<article data-main="1"><h1>A walk along the river</h1><p>The path begins behind the old mill and follows the water north.</p>
<p>Most people turn back at the bridge, but the better part of the walk comes after it.</p>
<p><b>What to take.<br><p>Water, a hat and something to sit on.</p></article>
<footer>&copy; river.example &middot; All rights reserved.</footer></body></html>""",
    """<html><body data-main="0"><header><h1>Daily Lantern</h1><p>News since 1901</p></header>
<ul class="menu"><li><a href="/p">Politics</a></li><li><a href="/s">Sport</a></li></ul>
<main><article data-main="1"><h1>Council votes on the park</h1><h2>Twelve for, three against</h2>
<p>The council has voted to keep the park open at night, after a debate of four hours.</p>
<div class="ad" data-main="0">Sponsored: new kitchens from 99 a month.</div>
<p>Residents had asked for lights along the southern path.</p>
<ul><li>Lights will be fitted in spring.</li><li>The gate stays open until midnight.</li></ul>
<p>Work starts in March.</p></article></main>
<aside class="sidebar"><h3>Most read</h3><ul><li><a href="/1">Bakery closes after fifty years</a></li><li><a href="/2">River floods the lower town again</a></li></ul></aside>
<section class="comments"><h3>Comments</h3><div class="comment"><p>I am glad that they listened to us this time.</p></div><div class="comment"><p>Who pays for all of this? Nobody asked me.</p></div></section>
<footer><p>Contact: desk@lantern.example</p><p>Privacy and terms</p></footer></body></html>""",
    """<html><body data-main="0"><div id="header"><a href="/">Seed notes</a></div><div id="nav"><a href="/a">Archive</a> | <a href="/b">Links</a></div>
<div class="cookie-notice"><p>We use cookies to make this site work. By going on you accept them.</p><button>Accept</button></div>
<div id="content" data-main="1"><h2>Saving tomato seed</h2><p>Choose a ripe fruit from a healthy plant and cut it across the middle.</p>
<blockquote>Leave the seeds in water for three days, until a skin forms.</blockquote><p>Then rinse and dry them on a plate.</p>
<table><tr><th>Kind</th><th>Days</th></tr><tr><td>Beefsteak</td><td>85</td></tr></table></div>
<form class="subscribe"><label>Your mail</label><input name="m"><button>Subscribe</button></form>
<div id="footer"><p>Powered by a small engine</p></div></body></html>""",
    """<html><body data-main="0"><div class="topbar">Free delivery over 30</div><div class="wrapper"><div class="breadcrumb"><a href="/">Start</a> / <a href="/g">Garten</a></div>
<div class="post" data-main="1"><h1>Der Garten im Winter</h1><p>Im Winter ruht der Garten, aber es gibt genug zu tun.</p><p>Die Werkzeuge werden gereinigt und die Wege vom Schnee befreit.</p>
<div class="share" data-main="0"><a href="#">Teilen</a> <a href="#">Drucken</a></div><p>Im Februar beginnt die Aussaat auf der Fensterbank.</p></div>
<div class="related"><h4>Mehr zum Thema</h4><a href="/x">Rosen schneiden leicht gemacht</a><a href="/y">Kompost im Winter</a></div>
<div class="sidebar"><p>Neu im Laden: Handschuhe aus Leder.</p></div></div><div class="footer">Impressum</div></body></html>""",
    """<html><body data-main="0"><header><nav><a href="/">Accueil</a><a href="/r">Recettes</a></nav></header><section class="article" data-main="1"><h1>Le pain de campagne</h1>
<p>Il faut de la farine, de l'eau, du sel et beaucoup de patience.</p><h3>La veille</h3><p>On prépare le levain et on le laisse reposer toute la nuit.</p>
<pre>500 g de farine
350 g d'eau</pre><p>Le lendemain, on pétrit puis on enfourne.</p></section>
<section id="comments"><p>Merci, la recette est parfaite pour les enfants.</p><p>Chez moi il a trop cuit, dommage.</p><form><textarea></textarea><button>Envoyer</button></form></section>
<aside><div class="advert">Un four neuf pour la rentrée, en promotion.</div></aside><footer>Mentions légales</footer></body></html>""",
    """<html><body data-main="0"><div class="notice">This site will be down on Sunday for repairs.</div><nav class="navbar"><ul><li><a href="/d">Docs</a></li><li><a href="/c">Code</a></li></ul></nav>
<main data-main="1"><h1>Installing the tool</h1><p>Unpack the archive and run the installer from its folder.</p><ol><li>Open a terminal.</li><li>Go to the folder.</li><li>Start the installer.</li></ol>
<h2>Problems</h2><p>If the installer stops, look into the log. See <a href="/log">the page on logs</a> for what the lines mean.</p></main>
<div class="pagination"><a href="?p=1">1</a><a href="?p=2">2</a></div><footer><ul><li><a href="/t">Terms</a></li><li><a href="/p">Privacy</a></li></ul></footer></body></html>""",
    """<html><body data-main="0"><div class="banner advertisement">The summer sale has begun. Everything must go.</div><div id="menu"><ul><li>Inicio</li><li>Noticias</li><li>Deportes</li></ul></div>
<div class="entry-content" data-main="1"><h1>La feria del libro</h1><p>La feria abrió sus puertas el viernes con más de cien casetas.</p><p>Los lectores hicieron cola desde las ocho de la mañana.</p><p>El domingo se entregan los premios.</p></div>
<div class="social">Síguenos</div><div class="reader-comments"><ol><li><p>Yo fui el sábado y había demasiada gente.</p></li><li><p>El año que viene vuelvo seguro.</p></li></ol></div><div class="site-footer">Aviso legal</div></body></html>""",
    """<html><body data-main="0"><nav><a href="/">Home</a></nav><article data-main="1"><header data-main="0"><p>Reading time: 4 minutes</p></header><h1>Why bridges hum</h1><p>On windy days the cables of a bridge can be heard from far away.</p>
<figure><figcaption>The bridge at dusk.</figcaption></figure><p>The air behind a cable turns in small circles, first to one side and then to the other.</p><aside data-main="0"><p>Also on this site: how tunnels breathe.</p></aside>
<p>When the circles come as often as the cable likes to swing, it sings.</p><footer data-main="0"><p>Filed under physics</p></footer></article><div class="popup"><p>Join our newsletter and never miss a story.</p></div></body></html>""",
    """<html><body data-main="0"><table class="layout"><tr><td class="left menu"><a href="/1">One</a><br><a href="/2">Two</a></td><td class="main" data-main="1"><p>This page has not changed since it was first written, and it need not.</p><p>It lists the lighthouses of the coast from north to south, with the year each was lit.</p><p>Send corrections by letter.</p></td></tr></table>
<p class="copyright">Copyright by the author</p></body></html>""",
    """<html><body data-main="0"><ul><li><a href="/And">And</a></li><li><a href="/more">more</a></li></ul><div class="ad">Sell your car in a day, with no fees at all.</div><article data-main="1"><h1>Short note.</h1><p>A short note is still a note.</p></article><div class="promo">Download our app.</div><footer>&copy; m.notes.example &middot; Made by hand in a small town near the sea.</footer></body></html>""",
    """<html><body data-main="0"><div class="login"><form><label>Name</label><input><button>Log in</button></form></div><div class="story" data-main="1"><h1>The clockmaker</h1><p>There was a clockmaker who never knew what time it was.</p><p>"It is always now," he said, when somebody asked.</p><div><p>One day a child brought him a watch without hands.</p></div><p>He looked at it for a long time. Then he smiled.</p></div>
<div class="disclaimer">Nothing on this page is advice.</div><div class="widget">Tags: clocks, time</div></body></html>""",
    """<html><body data-main="0"><nav><ul><li><a href="/w">words</a></li><li><a href="/l">lists</a></li></ul></nav><div class="ad">Learn ten words a day.</div><article data-main="1"><h1>word | list | of | the | north</h1><p>fjord | fell | beck | tarn | scar | force | gill</p><p>Copyright by the collectors</p><p>dale</p><p>thwaite garth toft by</p></article><footer>&copy; words.example &middot; Printed in the north.</footer></body></html>""",
    """<html><body data-main="0"><nav><ul><li><a href="/x">x</a></li></ul></nav><div class="ad">Rings and chains, mended while you wait.</div><article data-main="1"><h1>One line</h1><p>only this and no more</p></article><footer>&copy; one.example &middot; Nothing to see.</footer></body></html>""",
)

# Layouts: {t} is a title, {a} to {e} are paragraphs, {s} a short line, {x} and {y} words of other people or of shops.
LAYOUTS = (
    # drawings that close themselves, code and a figure inside the article
    """<html><body data-main="0"><header><svg width="1"/><a href="/">{s}</a></header><article data-main="1"><h1>{t}</h1><p>{a}</p><pre>{b}
{s}</pre><p>{c}</p><figure><img src="i"><figcaption>{s}</figcaption></figure><p>{d}</p></article><footer>&copy; {s} &middot; {x}</footer></body></html>""",
    # paragraphs that are bare divs
    """<html><body data-main="0"><div><a href="/1">{s}</a> <a href="/2">{s}</a></div><div data-main="1"><div>{a}</div><div>{b}</div><div>{c}</div><div>{d}</div></div><div class="footer">{s}</div></body></html>""",
    # bare divs below a heading, links around them
    """<html><body data-main="0"><ul><li><a href="/1">{s}</a></li><li><a href="/2">{x}</a></li></ul><div data-main="1"><h1>{t}</h1><div>{a}</div><div>{b}</div><div>{e}</div></div><div><a href="/n">{s}</a></div></body></html>""",
    # reader comments outside the article
    """<html><body data-main="0"><nav><a href="/">{s}</a></nav><article data-main="1"><h1>{t}</h1><p>{a}</p><p>{b}</p><p>{c}</p></article><section class="comments"><h2>{s}</h2><article class="comment"><p>{x}</p></article><article class="comment"><p>{y}</p></article></section></body></html>""",
    # a comment list, a form and related posts after a post
    """<html><body data-main="0"><div id="masthead"><h1>{s}</h1></div><div class="post hentry" data-main="1"><h2>{t}</h2><p>{a}</p><p>{d}</p><blockquote><p>{c}</p></blockquote></div><div class="related posts"><p>{x}</p></div>
<ol class="commentlist"><li><p>{y}</p></li><li><p>{x}</p></li></ol><form class="comment-form"><label>{s}</label><button>{s}</button></form></body></html>""",
    # an encyclopedia page: contents, table, lists, notes
    """<html><body data-main="0"><div id="sidebar"><ul><li><a href="/r">{s}</a></li></ul></div><main data-main="1"><h1>{t}</h1><p>{a}</p><div class="toc" data-main="0"><ul><li><a href="#1">{s}</a></li><li><a href="#2">{s}</a></li></ul></div>
<h2>{s}</h2><p>{b}</p><table><caption>{s}</caption><tr><th>{s}</th><td>{c}</td></tr></table><dl><dt>{s}</dt><dd>{d}</dd></dl></main><footer><p>{x}</p><p>{y}</p></footer></body></html>""",
    # layout by tables
    """<html><body data-main="0"><table><tr><td class="nav"><a href="/">{s}</a><br><a href="/2">{s}</a></td><td class="content" data-main="1"><h1>{t}</h1><p>{a}<p>{b}<p>{c}</td><td class="ads">{x}</td></tr><tr><td class="bottom">{s}</td></tr></table></body></html>""",
    # adverts and a newsletter form between paragraphs
    """<html><body data-main="0"><div class="cookie banner"><p>{x}</p><button>{s}</button></div><div class="article-body" data-main="1"><h1>{t}</h1><p>{a}</p><div class="advert" data-main="0"><p>{y}</p></div><p>{b}</p><form class="newsletter" data-main="0"><p>{x}</p><input><button>{s}</button></form><p>{c}</p></div></body></html>""",
    # a manual: lists, code and definitions
    """<html><body data-main="0"><header role="banner"><nav><a href="/">{s}</a></nav></header><div role="main" data-main="1"><h1>{t}</h1><p>{a}</p><ol><li>{b}</li><li>{s}</li></ol><pre><code>{s}
{c}</code></pre><p>{d}</p><ul><li>{e}</li></ul></div><div role="contentinfo">{s}</div></body></html>""",
    # a story with pictures, an aside and an author's box
    """<html><body data-main="0"><nav><ul><li><a href="/">{s}</a></li></ul></nav><article data-main="1"><header><h1>{t}</h1></header><p>{a}</p><figure><figcaption>{e}</figcaption></figure><aside class="pull" data-main="0"><p>{x}</p></aside><p>{b}</p><h2>{s}</h2><p>{c}</p></article><aside class="author"><p>{y}</p></aside><footer>&copy; {s}. {y}</footer></body></html>""",
    # text with line breaks only
    """<html><body data-main="0"><div class="menu"><a href="/">{s}</a></div><div class="text" data-main="1">{a}<br><br>{b}<br><br>{c}</div><div class="sidebar widget"><h3>{s}</h3><p>{x}</p></div><div class="legal">{s}</div></body></html>""",
    # a page that ends with its article
    """<html><body data-main="0"><nav><a href="/">{s}</a><a href="/2">{s}</a></nav><article data-main="1"><h1>{t}</h1><p>{a}</p><p>{b}</p><figure><figcaption>{s}</figcaption></figure><p>{e}</p></article></body></html>""",
    # a page that is nothing but its text
    """<html><body data-main="1"><h1>{t}</h1><p>{a}</p><p>{c}</p><p>{d}</p></body></html>""",
    # a page that begins with its article
    """<html><body data-main="0"><main data-main="1"><h1>{t}</h1><p>{a}</p><p>{b}</p><pre>{c}</pre></main><section class="comments"><p>{y}</p></section><footer>&copy; {s} &middot; {y}</footer></body></html>""",
    # a page of sections without classes
    """<html><body data-main="0"><header><p>{s}</p></header><main data-main="1"><section><h1>{t}</h1><p>{a}</p></section><section><h2>{s}</h2><p>{b}</p><p>{c}</p><ul><li>{d}</li><li>{e}</li></ul></section></main><aside><h2>{s}</h2><p>{x}</p></aside><footer>{s} &middot; {y}</footer></body></html>""",
)

TEXTS = (
    dict(
        t="How the harbour was dredged", s="Harbour notes", a="The harbour had been filling with sand for a hundred years before anybody thought of measuring it.", b="A rope with a lead was let down every ten steps.",
        c="They found that the deepest place lay where the old charts showed a bank, and the other way round.", d="The work took three summers.", e="Sand from the harbour now lies under the market square.",
        x="Great offers on sails, today only!", y="I remember this, my uncle was on the boat.",
    ),
    dict(
        t="Wie man ein Fahrrad flickt", s="Werkstatt", a="Zuerst wird das Rad ausgebaut und der Mantel mit zwei Hebeln von der Felge gezogen.", b="Den Schlauch pumpt man auf und hält ihn ins Wasser.",
        c="Wo Blasen steigen, ist das Loch; man trocknet die Stelle, rauht sie auf und trägt den Kleber dünn auf.", d="Nach fünf Minuten kommt der Flicken darauf.", e="Am Ende wird alles wieder eingebaut.",
        x="Jetzt neu im Laden, nur solange der Vorrat reicht!", y="Bei mir hat das leider nicht gehalten.",
    ),
    dict(
        t="Les nuages du soir", s="Carnet", a="Quand le soleil descend, les nuages prennent d'abord la couleur du miel, puis celle des braises.", b="Cela ne dure que quelques minutes.",
        c="La lumière traverse alors une plus grande épaisseur d'air, qui retient le bleu et laisse passer le rouge.", d="Après la pluie, les couleurs sont plus vives.", e="Les peintres le savaient bien avant les savants.",
        x="Abonnez-vous dès maintenant et recevez un cadeau.", y="Très beau texte, merci beaucoup à vous.",
    ),
)

GROUPS = tuple((page,) for page in SINGLE) + tuple(tuple(layout.format(**text) for text in TEXTS) for layout in LAYOUTS)
PAGES = tuple(page for group in GROUPS for page in group)
