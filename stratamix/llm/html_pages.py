"""Small pages labelled by hand: a block that begins with + is text of the article, one with - is not; {n} stands for n words."""

from __future__ import annotations

import re


def expanded(page: str) -> str:
    return re.sub(r"\{(\d+)\}", lambda m: " ".join(["word"] * int(m[1])), page)


PAGES = (
    # an article element between menu, advert and footer
    "<nav><ul><li><a>-{1}</a><li><a>-{2}</a><li><a>-{1}</a></ul></nav><div class=ad>-{12}</div><article><h1>+{9}</h1><p>+{80}<br>{30}<p>+{45}<p>+{1}<p>+{60}</article><footer>-{11}</footer>",
    "<div id=top-menu><a>-{1}</a></div><article><h1>+{4}</h1><p>+{2}<p>+{3}<p>+{1}</article><div class='sponsored links'><p>-{40}<p>-{25}</div><footer>-{6} <a>{3}</a></footer>",
    "<header><a>-{2}</a></header><main><h1>+{7}</h1><p>+{35} <a>{4}</a> {20}<h2 id=notice-period>+{2}</h2><p>+{50}<section id=search-engines><h2>+{2}</h2><p>+{28}</section></main><aside><h3>-{2}</h3><p>-{30}</aside>",
    "<p>-{30}<p>-{8}<article><p>+{5}<ul><li>+{6}<li>+{9}<li>+{3}</ul><table><tr><td>+{1}<td>+{2}</table><blockquote>+{22}</blockquote><p>+{14}</article><p>-{60}<p>-{4}",
    "<div>-{6}</div><div>-{90}</div><main><h1>+{3}</h1><p>+{110}<p>+{70}</main><div>-{45}</div><div><a>-{2}</a></div>",
    # lists of links inside an article: no text of it, unlike links in running text and single linked lines
    "<article><h1>+{6}</h1><p>+{55}<p>+{40} <a>{6}</a><ul><li><a>-{4}</a><li><a>-{5}</a><li><a>-{3}</a><li><a>-{6}</a></ul></article><footer>-{9}</footer>",
    "<main><ul><li><a>-{2}</a><li><a>-{3}</a><li><a>-{2}</a></ul><h1>+{5}</h1><p>+{24}<p><a>+{7}</a><p>+{65}</main>",
    "<nav><a>-{1}</a></nav><article><p><a>-{1}</a><p><a>-{2}</a><h1>+{8}</h1><p>+{12} <a>{5}</a> {3}<p>+{2} <a>{6}</a><p>+{31}</article>",
    "<article><h2><a>+{5}</a></h2><p>+{33}<h2><a>+{4}</a></h2><p>+{21}<p>+{18} <a>{12}</a></article><div class=related><a>-{4}</a></div>",
    "<article><h2>+{1}</h2><ul><li><a>-{3}</a><li><a>-{4}</a></ul><p>+{2}<ul><li><a>-{5}</a><li><a>-{2}</a><li><a>-{3}</a></ul><p>+{4}</article>",
    "<main><h1>+{3}</h1><p>+{1}<p><a>+{9}</a><p>+{5}<p>+{3}</main><p><a>-{4}</a>",
    "<article><h1>+{2}</h1><ul><li><a>-{2}</a><li><a>-{6}</a></ul><p>+{10}<p>+{2}<ul><li><a>-{1}</a><li><a>-{1}</a></ul></article><div>-{50}</div>",
    "<div>-{3}</div><article><h1>+{6}</h1><p>+{20}<p>+{2}</article>", "<article><p>+{3}</article>", "<article><h1>+{1}</h1><p>+{8}<p>+{1}</article>", "<main><p>+{7}<p>+{60}<p>+{9}</main>",
    "<article><p>+{90}<p>+{4}<p>+{3}<p>+{8}</article>", "<article><p>+{2}<p><a>+{6}</a><p>+{1}</article>",
    "<article><p>+{60}<p>+{5}<ul><li><a>-{3}</a><li><a>-{3}</a></ul><p>+{20}</article>", "<main><h1>+{4}</h1><p>+{33}<h2>+{2}</h2><ul><li><a>-{1}</a><li><a>-{2}</a></ul></main>",
    # linked headings and long links, of an article or of furniture
    "<header><h1><a>-{2}</a></h1></header><article><h1><a>+{7}</a></h1><p>+{40}<div class=related><ul><li><a>-{9}</a><li><a>-{11}</a></ul></div><nav><a>-{8}</a></nav></article><aside><h3><a>-{5}</a></h3></aside>",
    "<h1><a>-{1}</a></h1><main><h2><a>+{3}</a></h2><p>+{17}<p>+{30}<aside><h4><a>-{9}</a></h4><p>-{12}</aside></main><h3><a>-{4}</a></h3><p>-{20}<h3><a>-{8}</a></h3>",
    "<div class=sidebar><h3><a>-{3}</a></h3><p>-{15}<h3><a>-{9}</a></h3></div><h1>+{5}</h1><p>+{55}<p>+{40}<nav><h4><a>-{2}</a></h4></nav>",
    "<nav><p>-{10} <a>{25}</a></nav><article><p>+{30} <a>{20}</a><div class=related><p>-{5} <a>{40}</a></div><p>+{9} <a>{30}</a></article><footer>-{3} <a>{9}</a><p><a>-{33}</a><p>-{4} <a>{6}</a></footer>",
    "<header><p>-{4} <a>{3}</a></header><div class=menu><p>-{4} <a>{30}</a></div><p>+{60}<p>+{35} <a>{15}</a><div id=sidebar><p>-{2} <a>{12}</a><p>-{8} <a>{28}</a></div><footer><a>-{40}</a></footer>",
    "<p>-{12} <a>{30}</a><p><a>-{7}</a><main><p>+{5} <a>{3}</a><form><p>-{3} <a>{5}</a></form><p>+{10} <a>{28}</a><aside><p>-{4} <a>{33}</a></aside><p>+{12}</main><p>-{3} <a>{4}</a><p>-{25} <a>{40}</a>",
    "<article><h1>+{4}</h1><nav><ul><li><a>-{8}</a><li><a>-{12}</a><li><a>-{7}</a></ul></nav><p>+{50}<div class=share><p>-{2} <a>{4}</a><p><a>-{6}</a></div><p>+{14} <a>{16}</a><p>+{22}<div class=promo-box><a>-{14}</a></div><p>+{8}<footer><p><a>-{9}</a><p>-{1} <a>{7}</a></footer></article>",
    "<main><div class=sponsored><p><a>-{20}</a></div><p>+{12} <a>{12}</a><p>+{6}<aside><a>-{25}</a></aside><p>+{30}<p>+{3} <a>{8}</a><div id=comments><p>-{4} <a>{4}</a><p>-{2} <a>{9}</a></div><form><a>-{7}</a></form></main>",
    "<article><h2>+{3}</h2><p><a>+{12}</a><p>+{40}<aside><h3><a>-{4}</a></h3><a>-{16}</a></aside><p>+{2} <a>{14}</a><p>+{70}<nav><h4><a>-{3}</a></h4><p>-{1} <a>{10}</a></nav><p>+{33}<p><a>+{24}</a></article>",
    "<main><div class=menu><h3><a>-{2}</a></h3><a>-{13}</a></div><p>+{26}<p><a>+{18}</a><p>+{64}<h3><a>+{6}</a></h3><p>+{15}<div class=related-links><h4><a>-{7}</a></h4><p><a>-{19}</a></div><p>+{58}</main>",
    # furniture inside an article, by tag or by name
    "<article><h1>+{5}</h1><p>+{48}<div class=ad-slot>-{9}</div><p>+{37}<aside>-{14}</aside><p>+{52}<section id=comments><h3>-{2}</h3><p>-{34}<p>-{7}</section></article>",
    "<main><h1>+{6}</h1><form><label>-{1}</label></form><p>+{70}<div class=newsletter>-{16}</div><p>+{5}<div class='share buttons'><a>-{1}</a></div><nav><a>-{3}</a></nav></main>",
    "<article><header><h1>+{7}</h1><p>+{3}</header><p>+{41}<div class=cookie-notice><p>-{27}</div><p>+{29}<div class=comment><p>-{80}</div><footer>-{5}</footer></article>",
    "<article class=post><div class=article-header><p>+{11}</div><p class=share-price>+{44}<div id=related-work><p>+{38}<p>+{6}</div></article><article class=comment><p>-{22}</article>",
    # no main element: running text among lists of links
    "<ul><li><a>-{1}</a><li><a>-{2}</a><li><a>-{1}</a></ul><h1>+{6}</h1><p>+{45}<p>+{60} <a>{3}</a><p>+{3}<p>+{50}<ul><li><a>-{4}</a><li><a>-{3}</a></ul><p>-{8}",
    "<div><a>-{2}</a></div><div><a>-{1}</a></div><div>-{3}</div><div><a>-{1}</a></div><h2>+{5}</h2><div>+{70}</div><div>+{12}</div><div>+{40}</div><div>-{2} <a>{4}</a></div><div><a>-{2}</a></div>",
    "<h1>+{4}</h1><p>+{30}<p>+{22}<p>+{9}<p>+{35}<h3>-{2}</h3><ul><li><a>-{5}</a><li><a>-{6}</a><li><a>-{4}</a></ul>",
    "<table><tr><td><a>-{1}</a><td><a>-{1}</a></table><p>+{16}<p>+{80}<p>+{7}<p>+{33}<p>-{5} <a>{2}</a>",
    "<div><a>-{3}</a> - <a>{2}</a></div><h1>+{9}</h1><div>+{25} <a>{2}</a></div><div>+{18}</div><div>+{26}</div><div>-{6} <a>{7}</a></div><div>-{2}</div>",
    "<p>-{2} <a>{3}</a><p>+{38}<h2>+{3}</h2><p>+{20}<p>+{41}<h2>+{2}</h2><p>+{15}<p>-{3} <a>{9}</a><p>-{1} <a>{3}</a>",
    "<ul><li><a>-{2}</a><li>-{2}<li><a>-{3}</a></ul><p>+{90}<p>+{4}<p>+{75}<ul><li>+{6}<li>+{5}<li>+{7}</ul><p>+{31}",
    # no main element: furniture by tag or name, long as text
    "<header><p>-{14}</header><nav><a>-{1}</a></nav><h1>+{5}</h1><p>+{60}<p>+{34}<div class=sidebar><p>-{42}<p>-{30}</div><footer><p>-{20}<p>-{9}</footer>",
    "<div class=cookies><p>-{35}</div><div class=content><p>+{28}<p>+{19}<p>+{47}</div><div id=comments><h3>-{2}</h3><p>-{55}<p>-{18}</div><div class=footer>-{13}</div>",
    "<div class=banner>-{10}</div><div class=menu><a>-{1}</a></div><p>+{23}<p>+{44}<form>-{4}</form><p>+{36}<div class=advertisement><p>-{21}</div><p>+{29}",
    # hardly anything but text, or nothing of it
    "<p>+{12}", "<h1>+{3}</h1><p>+{40}", "+{25}", "<p>+{6}<p>+{8}<p>+{5}", "<div>+{4}</div><div>+{11}</div>",
    "<ul><li><a>-{1}</a><li><a>-{2}</a><li><a>-{3}</a><li><a>-{1}</a></ul>", "<p><a>-{3}</a><p>-{2} <a>{5}</a><p><a>-{8}</a>", "<div><a>-{6}</a></div><div>-{4} <a>{20}</a></div>",
)
