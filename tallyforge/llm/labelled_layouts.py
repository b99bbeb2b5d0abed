"""Labelled pages: layouts written for this library, from which the potentials of html_text are counted.

data-main="1" marks the main text and data-main="0" a part of it that is not; what is inside
an element has its label. {n} stands for n words of prose, {n:a} for links of n words in all,
one or two words each. No layout is taken from a real site.
"""

LAYOUTS = [
    # Pages built of the elements made for each part.
    '<header><a href="/">{2}</a><nav><ul>{8:a}</ul></nav></header><main data-main="1"><article><h1>{7}</h1><p>{60}</p><p>{45}</p><h2>{4}</h2><p>{80}</p><ul><li>{9}</li><li>{12}</li></ul><p>{30}</p></article></main><aside data-main="0"><h3>{2}</h3><ul>{9:a}</ul></aside><footer><p>{9}</p></footer>',
    '<nav><ul>{6:a}</ul></nav><div class="ad">{6}</div><article data-main="1"><h1>{6}</h1><p>{3}</p><p>{30}</p><p>{8}</p></article><footer>{6}</footer>',
    '<nav>{7:a}</nav><div class="ads">{12}</div><article data-main="1"><h1>{5}</h1><p>{90}</p><p>{1}</p><p>{70}</p></article><footer>{5}</footer>',
    '<nav><ul>{12:a}</ul></nav><div class="advert">{9}</div><article data-main="1"><h1>{6}</h1><p>{2}</p></article><footer>{7}</footer>',
    '<header role="banner"><h1><a href="/">{3}</a></h1><form role="search"><label>{1}</label></form></header><main data-main="1" id="main"><article><header><h1>{8}</h1></header><p>{50}</p><blockquote><p>{25}</p></blockquote><p>{60}</p><figure><figcaption>{10}</figcaption></figure><p>{22}</p><section class="comments" id="comments" data-main="0"><h2>{2}</h2><article class="comment"><p>{18}</p></article><article class="comment"><p>{40}</p></article></section></article></main><footer role="contentinfo"><p>{12}</p><ul>{6:a}</ul></footer>',
    '<div class="notice" role="alert"><p>{14}</p></div><nav role="navigation">{6:a}</nav><article data-main="1"><h1>{6}</h1><p>{35}</p><div class="advertisement" data-main="0"><p>{8}</p></div><p>{44}</p><aside class="related" data-main="0"><h4>{2}</h4>{6:a}</aside><p>{51}</p></article><footer>{8}</footer>',
    '<header class="site-header"><nav class="main-menu">{10:a}</nav></header><main><article data-main="1"><h1>{5}</h1><p>{28}</p><table><tr><th>{1}</th><th>{2}</th></tr><tr><td>{1}</td><td>{3}</td></tr><tr><td>{2}</td><td>{1}</td></tr></table><p>{33}</p></article><section class="related"><h2>{2}</h2><article class="card teaser"><h3><a href="/a">{6}</a></h3><p>{12}</p></article><article class="card teaser"><h3><a href="/b">{7}</a></h3><p>{11}</p></article></section></main><footer class="site-footer">{11}</footer>',
    '<nav>{9:a}</nav><main data-main="1"><h1>{4}</h1><p>{70}</p><p>{55}</p><ol><li>{14}</li><li>{16}</li></ol><form data-main="0"><label>{2}</label><p>{6}</p></form></main><section id="comments"><h3>{2}</h3><p>{20}</p><p>{9}</p><form id="commentform"><p>{5}</p></form></section><footer><nav>{5:a}</nav><p>{7}</p></footer>',
    '<aside class="sidebar"><h3>{1}</h3><ul>{8:a}</ul><p>{15}</p></aside><article data-main="1"><h1>{7}</h1><p>{41}</p><p>{4}</p><p>{66}</p><pre>{20}</pre></article><aside class="sidebar right"><p>{20}</p></aside><footer>{9}</footer>',
    # Pages of generic elements that have names.
    '<div id="header"><div class="logo"><a href="/">{2}</a></div><div id="menu"><ul>{9:a}</ul></div></div><div id="wrapper" class="container"><div id="content" data-main="1"><h1 class="title">{6}</h1><div class="post-body"><p>{65}</p><p>{40}</p><p>{52}</p></div></div><div id="sidebar"><div class="widget"><h3>{2}</h3><ul>{8:a}</ul></div><div class="widget"><p>{16}</p></div></div></div><div id="footer"><p>{10}</p></div>',
    '<div class="cookie-notice"><p>{24}</p><a href="#">{1}</a></div><div class="topbar menu">{7:a}</div><div class="container"><div class="row"><div class="col"><div class="article-content" data-main="1"><h1>{8}</h1><p>{38}</p><p>{47}</p><div class="ad-banner" data-main="0">{7}</div><p>{58}</p></div><div class="share social">{4:a}</div><div class="comments"><div class="comment"><p>{26}</p></div><div class="comment"><p>{7}</p></div></div></div></div></div><div class="footer">{12}</div>',
    '<div class="page"><div class="navbar">{8:a}</div><div class="breadcrumbs">{4:a}</div><div class="entry" data-main="1"><h2 class="entry-title">{5}</h2><div class="entry-content"><p>{72}</p><p>{31}</p></div></div><div class="pagination">{3:a}</div><div class="respond"><h3>{3}</h3><form><p>{8}</p></form></div><div class="footer-links">{6:a}</div></div>',
    '<div class="consent gdpr"><p>{30}</p></div><div class="masthead">{2:a}</div><div class="story" data-main="1"><h1>{9}</h1><p>{49}</p><p>{36}</p><h3>{3}</h3><p>{61}</p></div><div class="newsletter subscribe"><p>{13}</p><form><label>{2}</label></form></div><div class="recommended popular"><ul>{12:a}</ul></div><div class="copyright">{6}</div>',
    '<div id="nav">{6:a}</div><div class="inner"><div id="main-content" data-main="1"><h1>{6}</h1>{44}<p>{35}</p><p>{27}</p><dl><dt>{2}</dt><dd>{15}</dd><dt>{1}</dt><dd>{18}</dd></dl></div><div id="right-column" class="side"><div class="promo">{11}</div><div class="sponsored">{14}</div></div></div><div id="bottom">{8:a}</div>',
    '<div class="popup modal overlay"><p>{17}</p></div><div class="head">{5:a}</div><div class="content" data-main="1"><div class="text"><p>{88}</p><p>{25}</p><p>{14}</p></div></div><div class="discussion thread"><div class="reply"><p>{33}</p></div><div class="reply"><p>{12}</p></div></div><div class="legal disclaimer"><p>{28}</p></div>',
    '<div class="warning alert notice"><p>{19}</p></div><ul class="menu">{8:a}</ul><div class="main" data-main="1"><h1>{4}</h1><div class="section"><p>{43}</p></div><div class="section"><h2>{3}</h2><p>{56}</p><p>{6}</p></div></div><div class="banner ad sponsor"><p>{10}</p></div><div class="login signup"><form><label>{2}</label><p>{4}</p></form></div><div class="footer"><div class="row">{9:a}</div></div>',
    '<div class="header"><p>{5}</p></div><div class="text" data-main="1"><p>{62}</p><p>{37}</p></div><div class="comment-list"><h4>{2}</h4><ul class="comments"><li class="comment">{24}</li><li class="comment">{15}</li><li class="comment">{48}</li></ul></div><div class="footer"><p>{8}</p></div>',
    '<div class="menu navigation"><ul>{7:a}</ul></div><div class="ad advert"><p>{12}</p></div><div class="article" data-main="1"><h1>{6}</h1><p>{29}</p><p>{57}</p><div class="author byline">{4}</div><p>{23}</p></div><div class="feedback reviews"><div class="review"><p>{21}</p></div></div><div class="sidebar"><p>{18}</p><ul>{6:a}</ul></div><div class="footer">{9}</div>',
    '<div class="nav">{9:a}</div><div class="post" data-main="1"><h2>{6}</h2><p>{53}</p><p>{42}</p></div><div class="post" data-main="1"><h2>{5}</h2><p>{38}</p></div><div class="widget sidebar"><h3>{1}</h3>{10:a}</div><div class="cookie banner">{20}</div><div class="foot">{7}</div>',
    # Names in other languages.
    '<div class="menue navigation">{7:a}</div><div class="werbung anzeige"><p>{9}</p></div><div class="inhalt artikel" data-main="1"><h1>{5}</h1><p>{48}</p><p>{39}</p></div><div class="kommentare"><p class="kommentar">{17}</p><p class="kommentar">{22}</p></div><div class="fusszeile impressum">{8}</div>',
    '<div class="entete">{3:a}</div><div class="publicite"><p>{10}</p></div><div class="contenu" data-main="1"><h1>{6}</h1><p>{51}</p><p>{27}</p></div><div class="commentaires"><div class="commentaire"><p>{19}</p></div></div><div class="pied">{7}</div>',
    '<div class="cabecera">{4:a}</div><div class="publicidad anuncio"><p>{11}</p></div><div class="contenido articulo" data-main="1"><h1>{7}</h1><p>{46}</p><p>{34}</p></div><div class="comentarios"><div class="comentario"><p>{23}</p></div></div><div class="pie aviso">{9}</div>',
    # Pages without names, and pages of tables.
    '<div><a href="/">{1}</a> {6:a}</div><div data-main="1"><h1>{6}</h1><p>{54}</p><p>{48}</p><p>{61}</p></div><div>{5:a}</div><div><p>{6}</p></div>',
    '<table><tr><td>{8:a}</td></tr><tr><td data-main="1"><h1>{5}</h1><p>{75}</p><p>{40}</p>{33}</td><td>{9:a}</td></tr><tr><td>{6}</td></tr></table>',
    '<ul>{10:a}</ul><div data-main="1"><p>{66}</p><p>{39}</p><p>{5}</p><ul><li>{11}</li><li>{8}</li><li>{17}</li></ul><p>{28}</p></div><form><label>{2}</label><p>{7}</p></form><address>{6}</address>',
    '<form id="page"><div class="top">{7:a}</div><div data-main="1"><h1>{7}</h1><p>{44}</p><p>{59}</p></div><div>{5}</div></form>',
    '<h1 data-main="1">{6}</h1><p data-main="1">{42}</p><p data-main="1">{55}</p><p data-main="1">{30}</p>',
    '<nav>{5:a}</nav><h1 data-main="1">{5}</h1><p data-main="1">{33}</p><p data-main="1">{47}</p><div class="ad">{8}</div><p data-main="1">{38}</p><footer>{6}</footer>',
    '<nav>{8:a}</nav><section class="hero banner"><p>{7}</p></section><section data-main="1" itemprop="articleBody"><h1>{6}</h1><p>{41}</p><p>{50}</p></section><section class="faq related">{6:a}</section><section class="tags">{4:a}</section><footer>{8}</footer>',
    # Asides, adverts, comments and notes inside the text, long ones too.
    '<nav>{6:a}</nav><article data-main="1"><h1>{5}</h1><p>{45}</p><aside data-main="0"><p>{30}</p></aside><p>{38}</p><section class="comments" data-main="0"><p>{35}</p><p>{20}</p></section></article><footer><p>{24}</p><p>{18}</p></footer>',
    '<article data-main="1"><h1>{5}</h1><p>{45}</p><nav class="toc" data-main="0">{4:a}</nav><p>{38}</p><div class="newsletter" data-main="0"><p>{15}</p></div><p>{31}</p><footer data-main="0"><p>{9}</p></footer></article><aside><p>{26}</p></aside>',
    '<main data-main="1"><h1>{5}</h1><p>{45}</p><p>{3}</p></main><div class="comments"><p>{35}</p><p>{20}</p><p>{41}</p></div><div class="promo"><p>{25}</p></div><div class="sidebar"><p>{25}</p></div>',
    '<div class="header"><p>{21}</p></div><main data-main="1"><p>{45}</p><p>{38}</p></main><section class="comments"><p>{35}</p><p>{20}</p></section><div class="notice"><p>{25}</p></div><div class="cookie"><p>{22}</p></div><div class="footer"><p>{25}</p></div>',
    '<header><p>{15}</p></header><div class="content" data-main="1"><p>{45}</p><div class="ad" data-main="0"><p>{16}</p></div><p>{38}</p><div class="related" data-main="0"><p>{12}</p></div><p>{27}</p><div class="comments" data-main="0"><p>{35}</p></div></div><aside><p>{33}</p></aside><form><p>{12}</p></form>',
    '<div class="advert"><p>{20}</p></div><div class="article" data-main="1"><p>{45}</p><div class="advert" data-main="0"><p>{16}</p></div><p>{38}</p></div><div class="sidebar"><p>{33}</p></div><div class="comment"><p>{19}</p></div><div class="menu">{9}</div><div class="newsletter"><p>{20}</p></div>',
    '<div class="header"><h1>{3}</h1><p>{6}</p></div><div class="post" data-main="1"><h2>{6}</h2><p>{45}</p><p>{20}</p></div><div class="sidebar"><h3>{1}</h3><p>{30}</p></div><div class="footer"><p>{20}</p></div>',
    '<header><h1><a href="/">{2}</a></h1><p>{5}</p></header><article data-main="1"><h2>{6}</h2><p>{45}</p><p>{20}</p></article><footer><p>{20}</p></footer>',
    # Parts of the text in elements of their own.
    '<nav>{7:a}</nav><article data-main="1"><h1>{6}</h1><section><h2>{3}</h2><p>{45}</p><p>{20}</p></section><section><h2>{3}</h2><p>{41}</p></section><section><p>{33}</p><p>{12}</p></section></article><section><p>{12}</p></section><footer>{9}</footer>',
    '<div><div>{6:a}</div></div><div data-main="1"><div><div><h1>{6}</h1></div><div><p>{45}</p><p>{20}</p></div><div><p>{31}</p><div><p>{28}</p></div></div></div></div><div><div>{7}</div></div>',
    '<header>{3:a}</header><main data-main="1"><div><div><h1>{5}</h1><p>{45}</p></div><div><p>{29}</p></div><div>{30}</div></div><section><p>{36}</p><section><p>{26}</p></section></section></main><footer><div>{6}</div></footer>',
    '<div id="header">{5:a}</div><div id="content" data-main="1"><div class="section"><div class="inner"><p>{45}</p></div></div><div class="box"><p>{25}</p></div><table><tr><td>{3}</td><td>{2}</td></tr></table></div><div id="comments"><div class="inner"><p>{25}</p></div></div><div id="footer"><div class="inner">{8}</div></div>',
    # Nothing but text.
    '<p data-main="1">{30}</p><p data-main="1">{25}</p>',
    '<p data-main="1">{18}</p><p data-main="1">{45}</p><p data-main="1">{33}</p><p data-main="1">{12}</p>',
]
