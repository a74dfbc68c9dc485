"""Pages as people write them, none with <article>, labelled by hand: what follows {+} is content, what follows {-} is not."""

import re

PAGES = [
    # a blog post between divs
    """<!doctype html><html><head><title>Repairing a kettle</title></head><body><div id="wrap"><div class="top"><a href="/">{-}Home</a></div><ul class="menu"><li><a href="/about">{-}About</a></li><li><a href="/archive">{-}Archive</a></li><li><a href="/contact">{-}Contact</a></li></ul>
    <div class="post"><h1>{+}How I repaired an old kettle</h1><p>{+}Last week the kettle stopped working, so I opened it to see what was wrong with the switch.</p><p>{+}The contacts were covered with soot. After some minutes with fine sandpaper they looked like new, and the kettle boiled water again.</p><h2>{+}What you need</h2><ul><li>{+}A small screwdriver with a flat tip.</li><li>{+}Fine sandpaper, and a cloth to wipe the dust off.</li></ul><p>{+}Do not forget to unplug it first; water and electricity do not go well together.</p></div>
    <div class="sidebar"><h3>{-}Recent posts</h3><ul><li><a href="/1">{-}Sharpening knives</a></li><li><a href="/2">{-}A shelf from pallets</a></li></ul></div><div class="footer">{-}&copy; 2019 Workshop notes | All rights reserved</div></div></body></html>""",
    # news in a layout of tables
    """<html><body><table width="100%"><tr><td colspan="2"><a href="/">{-}News</a></td></tr><tr><td><a href="/w">{-}World</a><br><a href="/s">{-}</a></td><td><h2>{+}Bridge closed until spring</h2><p>{+}The old bridge over the river will stay closed until April, the town council said on Monday.</p><p>{+}Engineers found cracks in two of the four pillars during an inspection in autumn. Repairs are expected to cost about two million, of which the county pays half.</p><p>{+}Drivers have to take the road through the valley, which is some ten kilometres longer.</p></td></tr><tr><td colspan="2">{-}&copy; Valley Courier &middot; Imprint &middot; Privacy</td></tr></table></body></html>""",
    # main, header and footer, no classes
    """<html><body><header><p>{-}The Garden Letter</p><nav><ul><li><a href="a">{-}Vegetables</a></li><li><a href="b">{-}Flowers</a></li><li><a href="c">{-}Trees</a></li></ul></nav></header><main><h1>{+}Growing beans on a balcony</h1><p>{+}Beans need little room, but they need a pole to climb on and plenty of water in July.</p><blockquote>{+}Plant them after the last frost, never before, my grandmother used to say.</blockquote><p>{+}Sow the seeds three centimetres deep. When the plants are as high as a hand, tie them loosely to the pole.</p><p>{+}In August you can pick the first pods, and the more you pick, the more will grow.</p></main><footer><p>{-}Contact | Imprint | Newsletter</p></footer></body></html>""",
    # documentation with a long list of links before it
    """<html><body><div class="nav"><ul><li><a href="#1">{-}Install</a></li><li><a href="#2">{-}Configure</a></li><li><a href="#3">{-}Run</a></li><li><a href="#4">{-}Logs</a></li><li><a href="#5">{-}Upgrade</a></li><li><a href="#6">{-}Remove</a></li></ul></div><div class="content"><h1>{+}Configuring the server</h1><p>{+}The server reads its settings from a file when it starts. Each line holds a name and a value, with an equals sign between them.</p><p>{+}Lines that begin with a hash sign are comments and are not read. If a name occurs twice, the later value is used.</p><h2>{+}Ports</h2><p>{+}By default the server listens on one port only. To listen on more, write several numbers with commas between them.</p><p>{+}A port below 1024 needs special rights on most systems, so choose a higher one if you can.</p></div><div class="footer"><a href="/legal">{-}Legal</a></div></body></html>""",
    # a story with comments and sharing links
    """<html><body><div class="header"><a href="/">{-}Stories</a></div><div class="entry"><h1>{+}The lamp in the window</h1><p>{+}Every evening, when the fog came up from the harbour, the old woman put a lamp into her window.</p><p>{+}Nobody knew for whom she did it. Her husband had been dead for thirty years, and her sons lived in the city and seldom wrote.</p><p>{+}One night in November a boat without an engine drifted past the rocks, and its crew saw the light and rowed toward it.</p></div><div class="share social"><a href="#">{-}Share</a></div><div class="comments"><h3>{-}Comments</h3><div class="comment">{-}lovely</div><div class="comment">{-}me too</div></div><div class="footer">{-}&copy; Stories for the evening</div></body></html>""",
]


def labelled(page: str) -> tuple[str, list[int]]:
    """The page without marks and the labels of its blocks; a mark without text is no block."""
    marks = [m for m in re.finditer(r"\{([+-])\}([^<]*)", page) if m[2].strip()]
    return re.sub(r"\{[+-]\}", "", page), [int(m[1] == "+") for m in marks]
