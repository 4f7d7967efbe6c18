"""Pages written by hand in styles that no word list names, with their main text (blocks joined by |)."""

P1 = "The bridge over the river was opened in spring, after four years of work, and the first cars crossed it before noon."
P2 = "Its builders had planned for less; floods in the second year cost them a whole season, and steel became dear."
P3 = "Now the town hopes for visitors, while farmers on the other bank can reach the market in ten minutes instead of an hour."
ART = f"Bridge opened|{P1}|{P2}"

PAGES = {
    "unnamed neighbours": (f"<div class=qq1>Daily Planet</div><div class=zx2><h1>Bridge opened</h1><p>{P1}</p><p>{P2}</p></div><div class=qq3>Read this too</div>", ART),
    "table layout": (f"<table><tr><td>Home | About</td></tr><tr><td><h1>Bridge opened</h1><p>{P1}</p><p>{P2}</p></td></tr><tr><td>&copy; 2021 Planet Ltd</td></tr></table>", ART),
    "comment list": (f"<article><h1>Bridge opened</h1><p>{P1}</p><p>{P2}</p></article><ol class='commentlist'><li><b>Ann</b> says:<p>Great news!</p></li><li><b>Bo</b> says:<p>At last.</p></li></ol>", ART),
    "thread": (f"<article><h1>Bridge opened</h1><p>{P1}</p><p>{P2}</p></article><div id='disqus_thread'><div>Ann 2 days ago</div><div>Great news for the town!</div><div>Bo 3 days ago</div><div>I do not believe it.</div></div>", ART),
    "opinions": (f"<main><h1>Bridge opened</h1><p>{P1}</p><p>{P2}</p></main><section id='user-opinions'><h3>Opinions</h3><p>Ann: Great news.</p><p>Bo: At last, well done.</p></section>", ART),
    "formula": ("<article><h1>Bridge opened</h1><p>" + P1 + "</p><p>The span is <math><mi>x</mi><mo>+</mo><mn>2</mn></math> metres.</p><svg><title>t</title><text>Span in metres</text></svg><p>" + P2 + "</p></article><footer>&copy; x</footer>", f"Bridge opened|{P1}|The span is x+2 metres.|Span in metres|{P2}"),
    "nested drawing": (f"<article><h1>Bridge opened</h1><template><template>a</template>b</template><p>{P1}</p><p>{P2}</p></article>", ART),
    "by-line": (f"<nav><a href=/>Home</a> <a href=/n>News</a></nav><article><header><h1>Bridge opened</h1><p>By Ann Lee</p></header><p>{P1}</p><p>{P2}</p></article>", f"Bridge opened|By Ann Lee|{P1}|{P2}"),
    "letters for names": (f"<div id=k9><a href=1>One</a> <a href=2>Two</a> <a href=3>Three</a></div><div id=v4><div class=u><h1>Bridge opened</h1></div><div class=w><p>{P1}</p><p>{P2}</p><p>{P3}</p></div></div><div id=k2>Planet Ltd, all rights reserved</div>", f"{ART}|{P3}"),
    "no elements but div": (f"<div><div><a href=1>Start</a></div><div><a href=2>Shop</a></div></div><div><h1>Bridge opened</h1><div>{P1}</div><div>{P2}</div></div><div><div><a href=3>Imprint</a></div></div>", ART),
    "two columns": (f"<div class=c1><h1>Bridge opened</h1><p>{P1}</p><p>{P2}</p></div><div class=c2><h3>Most read</h3><ul><li><a href=1>Cat found on roof</a></li><li><a href=2>Rain until Friday</a></li></ul></div>", ART),
    "column first": (f"<div class=c2><h3>Most read</h3><ul><li><a href=1>Cat found on roof</a></li><li><a href=2>Rain until Friday</a></li></ul></div><div class=c1><h1>Bridge opened</h1><p>{P1}</p><p>{P2}</p></div>", ART),
    "list in the middle": (f"<section><h1>Bridge opened</h1><p>{P1}</p><ul><li>Length: 300 m</li><li>Lanes: two</li></ul><p>{P2}</p></section><footer>Planet</footer>", f"Bridge opened|{P1}|Length: 300 m|Lanes: two|{P2}"),
    "data table": (f"<main><h1>Bridge opened</h1><p>{P1}</p><table><tr><th>Year</th><th>Cost</th></tr><tr><td>2019</td><td>40</td></tr></table><p>{P2}</p></main>", f"Bridge opened|{P1}|Year|Cost|2019|40|{P2}"),
    "quote and code": (f"<article><h1>Bridge opened</h1><p>{P1}</p><blockquote>It will stand, she said.</blockquote><pre>a = 1</pre><p>{P2}</p></article>", f"Bridge opened|{P1}|It will stand, she said.|a = 1|{P2}"),
    "form at the end": (f"<div class=m7><h1>Bridge opened</h1><p>{P1}</p><p>{P2}</p><form><label>Your mail</label><button>Send</button></form></div>", ART),
    "notice on top": (f"<div class=x1><p>We use cookies.</p><button>OK</button></div><div class=x2><h1>Bridge opened</h1><p>{P1}</p><p>{P2}</p></div>", ART),
    "crumbs": (f"<div class=b><a href=/>Home</a> &gt; <a href=/n>News</a> &gt; Town</div><article><h1>Bridge opened</h1><p>{P1}</p><p>{P2}</p></article>", ART),
    "share row": (f"<article><h1>Bridge opened</h1><p>{P1}</p><p>{P2}</p><ul><li><a href=f>Share</a></li><li><a href=t>Tweet</a></li><li><a href=m>Mail</a></li></ul></article>", ART),
    "subheads": (f"<div class=t><h1>Bridge opened</h1><p>{P1}</p><h2>Costs</h2><p>{P2}</p><h2>Hopes</h2><p>{P3}</p></div><div class=s>Planet, 2021</div>", f"Bridge opened|{P1}|Costs|{P2}|Hopes|{P3}"),
    "deep wraps": (f"<div><div><div><div class=a1><h1>Bridge opened</h1><div class=a2><div class=a3><p>{P1}</p><p>{P2}</p></div></div></div></div></div></div><div><a href=1>Top</a></div>", ART),
    "no heading": (f"<div><a href=1>Start</a> | <a href=2>Shop</a></div><div><p>{P1}</p><p>{P2}</p><p>{P3}</p></div><div>Planet Ltd</div>", f"{P1}|{P2}|{P3}"),
    "links in prose": (f"<div class=q><h1>Bridge opened</h1><p>{P1} See <a href=1>the plans</a> for more.</p><p>{P2}</p></div><div class=r><a href=1>The plans of the bridge and what they cost</a></div>", f"Bridge opened|{P1} See the plans for more.|{P2}"),
    "inner advert": (f"<article><h1>Bridge opened</h1><p>{P1}</p><div class='promo-box'>Buy tyres now.</div><p>{P2}</p></article>", ART),
    "answers": (f"<article><h1>Bridge opened</h1><p>{P1}</p><p>{P2}</p><div class=z><div class=y><b>Ann</b> 2 hours ago<p>Great news.</p><a href=r>Reply</a></div><div class=y><b>Bo</b> 1 hour ago<p>Too late for me, I moved away.</p><a href=r>Reply</a></div></div></article>", ART),
    "headline above": (f"<h1>Bridge opened</h1><div class=n><a href=1>News</a> <a href=2>Sport</a></div><div class=o><p>{P1}</p><p>{P2}</p></div><div class=p>Imprint</div>", ART),
    "caption": (f"<article><h1>Bridge opened</h1><figure><img src=x><figcaption>The bridge at dawn.</figcaption></figure><p>{P1}</p><p>{P2}</p></article>", f"Bridge opened|The bridge at dawn.|{P1}|{P2}"),
    "definitions": (f"<main><h1>Bridge opened</h1><p>{P1}</p><dl><dt>Span</dt><dd>The length between two piers.</dd></dl><p>{P2}</p></main><aside><h3>See too</h3><p>Old ferry closes.</p></aside>", f"Bridge opened|{P1}|Span|The length between two piers.|{P2}"),
    "cards below": (f"<div class=aa><h1>Bridge opened</h1><p>{P1}</p><p>{P2}</p><p>{P3}</p></div><div class=bb><div class=cc><a href=1>Cat on roof</a><p>It came down alone.</p></div><div class=cc><a href=2>Rain</a><p>Until Friday, they say.</p></div></div>", f"{ART}|{P3}"),
    "breaks": (f"<div class=top>Planet</div><div class=txt><b>Bridge opened</b><br>{P1}<br><br>{P2}</div><div class=bot>1999</div>", f"Bridge opened {P1} {P2}"),
}
