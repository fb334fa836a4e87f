"""Labelled pages that the weights of the page extractor are counted over.

Written for this purpose in the layouts that sites commonly have.  What stands between the marks {{ and }}
is content; the rest is surroundings, also where it stands inside an article.
"""

BLOG = """<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>Keeping bees on a roof - The Allotment</title></head>
<body class="single single-post has-sidebar"><a class="skip-link" href="#content">Skip to content</a>
<header id="masthead" class="site-header" role="banner"><div class="site-branding"><h1 class="site-title"><a href="/">The Allotment</a></h1><p class="site-description">Notes from a small plot</p></div>
<nav id="site-navigation" class="main-navigation" role="navigation"><ul id="primary-menu" class="menu"><li class="menu-item"><a href="/">Home</a></li><li class="menu-item"><a href="/about">About</a></li><li class="menu-item"><a href="/shop">Shop</a></li></ul></nav></header>
<div id="content" class="site-content"><main id="main" class="site-main" role="main">{{<article id="post-81" class="post hentry"><header class="entry-header"><h1 class="entry-title">Keeping bees on a roof</h1>
<p class="entry-lead">It began with a swarm on the fire escape, and nobody in the house knew what to do.</p></header>
<div class="entry-content"><p>The first hive came in a van at six in the morning, and we carried it up four flights of stairs without a word.</p>
<p>By June the <a href="/lime">limes</a> were in flower, and the bees had found them long before we had.</p>
<blockquote><p>They fly three miles and never ask the way.</p></blockquote><h2>What they need</h2><ul><li>Water, not far away</li><li>Shelter from the wind</li><li>Somebody who looks in once a week</li></ul>
<figure class="wp-block-image"><img src="hive.jpg"><figcaption>The hive in its second year</figcaption></figure>}}<div class="ad ad-inline adsbygoogle"><p>Advertisement</p><a href="/buy">Cheap flights to the coast</a></div>{{<p>In autumn we took eleven jars, and gave nine of them away to the people who had been stung.</p></div>}}<footer class="entry-footer"><span class="cat-links">Posted in <a href="/bees">Bees</a></span><span class="tags-links"><a href="/t/roof">roof</a></span></footer>{{</article>}}
<nav class="navigation post-navigation"><div class="nav-links"><a href="/prev">Older post</a><a href="/next">Newer post</a></div></nav>
<div id="comments" class="comments-area"><h2 class="comments-title">Two thoughts on keeping bees</h2><ol class="comment-list"><li class="comment"><article class="comment-body"><footer class="comment-meta">Ann says</footer><div class="comment-content"><p>We tried this and the neighbours moved out.</p></div><div class="reply"><a href="#r">Reply</a></div></article></li></ol>
<div id="respond" class="comment-respond"><h3 id="reply-title">Leave a reply</h3><form id="commentform" class="comment-form"><p>Your address will not be published</p><textarea name="comment">Write here</textarea><input type="submit"></form></div></div></main>
<aside id="secondary" class="widget-area sidebar" role="complementary"><section class="widget widget_search"><form class="search-form" role="search"><label>Search for</label><input><button>Search</button></form></section><section class="widget widget_recent_entries"><h2 class="widget-title">Recent posts</h2><ul><li><a href="/1">Leeks</a></li><li><a href="/2">Compost</a></li></ul></section><section class="widget widget_archive"><h2>Archives</h2><select><option>May</option><option>June</option></select></section></aside></div>
<footer id="colophon" class="site-footer" role="contentinfo"><div class="site-info">Proudly grown by the Allotment, all rights reserved</div></footer></body></html>"""

NEWS = """<!DOCTYPE html><html><head><title>River falls to lowest level in decades | The Courier</title><style>a{color:red}</style></head><body>
<div class="cookie-banner consent gdpr" role="dialog"><p>We and our partners store cookies on your device</p><button>Accept all</button><button>Manage options</button></div>
<div class="topbar"><ul class="top-links"><li><a href="/sub">Subscribe</a></li><li><a href="/in">Sign in</a></li></ul></div>
<div id="header" class="header"><div class="logo"><a href="/">The Courier</a></div><div class="weather-widget">Rain later</div></div>
<div id="nav" class="navbar"><ul class="nav"><li><a href="/w">World</a></li><li><a href="/b">Business</a></li><li><a href="/s">Sport</a></li><li><a href="/c">Culture</a></li></ul></div>
<div class="breaking-news alert">Breaking: storm warning for the north</div>
<ol class="breadcrumb breadcrumbs"><li><a href="/">Home</a></li><li><a href="/e">Environment</a></li></ol>
<div class="advert banner-ad leaderboard"><span>Sponsored</span><a href="/x">Drive the new estate today</a></div>
<div class="container"><div class="row"><div class="col-md-8">{{<article class="story article"><h1 class="headline">River falls to lowest level in decades</h1><div class="standfirst"><p>Barges wait for rain as the gauge at the old bridge shows less than a metre.</p></div>
<div class="article-body"><p>Captains on the lower river said on Tuesday that they had not seen the sandbanks off the island since they were children.</p><p>The water authority expects the level to go down for another week, and has asked farms to pump at night only.</p>}}
<div class="newsletter-signup promo"><h3>Get our morning briefing</h3><p>Sign up for the newsletter</p><form><input type="email"><button>Sign up</button></form></div>
<aside class="related-links related"><h4>Related stories</h4><ul><li><a href="/1">Wells run dry in the hills</a></li></ul></aside>{{
<h2>Ferries stopped</h2><p>Two of the three ferries have stopped, and the third takes foot passengers alone.</p><table><tr><th>Place</th><th>Level</th></tr><tr><td>Old bridge</td><td>0.94</td></tr></table><p>Rain is forecast for the weekend, though not enough of it.</p></div></article>}}
<div class="share-buttons social-share"><a href="/f">Share</a><a href="/t">Tweet</a></div><div class="author-bio"><p>Our correspondent has written about water since the flood.</p></div>
<section class="comments" id="disqus_thread"><h2>Reader comments</h2><div class="comment"><p>They say this each summer.</p></div><div class="comment"><p>My grandfather walked across in his day.</p></div></section>
</div><div class="col-md-4 sidebar right-rail"><div class="most-read popular trending"><h3>Most read</h3><ol><li><a href="/a">Cup final replay ordered</a></li><li><a href="/b">Baker retires at ninety</a></li></ol></div><div class="ad ad-slot sponsored">Buy one, get one</div></div></div></div>
<div class="recommended"><h3>More from the Courier</h3><a href="/r">A walk along the dyke</a></div>
<div id="footer" class="footer"><ul class="footer-links"><li><a href="/t">Terms</a></li><li><a href="/p">Privacy</a></li></ul><p class="copyright">Copyright the Courier. All rights reserved</p></div></body></html>"""

MANUAL = """<html><head><title>Pumps: fitting</title></head><body><header role="banner"><a href="/">Pump manual</a></header>
<div class="wrapper page"><nav class="toc table-of-contents sidebar-nav"><ul><li><a href="#1">Unpacking</a></li><li><a href="#2">Fitting</a></li><li><a href="#3">Faults</a></li></ul></nav>
<main class="documentation">{{<section class="section"><h1>Fitting the pump</h1><p>Turn the water off before anything else, and drain the pipe at its lowest place.</p><pre>close valve
open drain</pre><p>Fit the collar with the arrow towards the tank. The nut takes <code>22</code> turns.</p>
<div class="note"><p>Old pipes may need a longer collar.</p></div><dl><dt>Collar</dt><dd>The ring that holds the pump</dd><dt>Drain</dt><dd>The lowest tap</dd></dl></section>
<section class="section"><h2>Faults</h2><table class="data"><thead><tr><th>Sign</th><th>Cause</th></tr></thead><tbody><tr><td>It hums</td><td>The rotor is stuck</td></tr><tr><td>It leaks</td><td>The collar is loose</td></tr></tbody></table><div class="example"><p>A pump that hums for an hour should be turned by hand.</p></div></section>}}
<div class="pager pagination"><a rel="prev">Unpacking</a><a rel="next">Spare parts</a></div></main></div><footer><p>Printed from the works, edition four</p></footer></body></html>"""

OLD = """<html><body bgcolor="white"><table width="100%"><tr><td class="menu"><a href="i.htm">Index</a><br><a href="g.htm">Guest book</a><br><a href="l.htm">Links</a></td><td>
{{<center><h1>The mill at the ford</h1></center><p>There has been a mill at the ford for as long as there has been a road, and the road is Roman.<p>The wheel that stands there now was built by two brothers, who quarrelled over its cost and never spoke again.
<hr><h3>How to find it</h3><p>Leave the train at the second halt, and walk towards the noise.</p>}}</td></tr></table><p class="disclaimer">This page is private and I am not to be held to it.</p><div class="counter">You are visitor 1041</div></body></html>"""

FORMS = """<html><head><title>Parish council</title></head><body><form id="aspnetForm" method="post"><div class="aspNetHidden"><input type="hidden"></div>
<div id="top" class="page-header"><div class="site-search search"><input><button>Go</button></div><a href="/">Parish council</a></div><div id="menu" class="menu dropdown-menu"><ul><li><a href="/m">Minutes</a></li><li><a href="/h">Hall hire</a></li></ul></div>
<div id="page" class="page-wrapper">{{<div class="content main-content"><h2>Minutes of the March meeting</h2><p>The chair opened the meeting at seven and read out two letters about the bins.</p><p>It was agreed that the hedge by the school should be cut before the birds return, and that the clerk would write to the owner.</p><p>The hall roof will be looked at again when there is money.</p></div>}}
<div class="login-box login"><p>Members sign in</p><input><button>Log in</button></div></div><div id="bottom" class="bottom footer-bar"><a href="/a">Accessibility</a><a href="/c">Contact</a></div></form></body></html>"""

FORUM = """<html><body><div class="navbar navigation"><a href="/">Board index</a><a href="/faq">Help</a><a href="/reg">Register</a></div><div class="notice announcement"><p>The board will be down on Sunday night</p></div>
<div class="body main"><div class="breadcrumbs"><a href="/">Index</a></div>{{<div class="post first"><h3>Which oil for a lathe of 1962?</h3><div class="post-body text"><p>I have been given a lathe that stood in a barn for thirty years, and the plate that names the oil is gone.</p><p>The ways are clean and the bearings turn, so I would rather not guess. What did you put in yours?</p></div></div>}}
<div class="signature">Sent from my workshop</div><div class="replies discussion"><h4>Answers</h4><div class="reply"><p>Use what the tractor has.</p></div><div class="reply"><p>Do not use what the tractor has.</p></div></div><div class="quick-reply"><form><textarea>Your answer</textarea><button>Post</button></form></div></div>
<div class="sidebar box"><h4>Who is here</h4><p>Four members and a search engine</p></div><div class="footer">Board software, in the public domain</div></body></html>"""

MAGAZINE = """<html><head><title>The long way down</title></head><body class="home"><div class="popup modal overlay newsletter"><p>Before you go: join our list</p><button>No thanks</button></div><header class="header sticky"><nav><a href="/">Magazine</a><a href="/issue">This issue</a></nav></header>
<div class="hero promo-banner"><a href="/sub">Half price for a year, subscribe now</a></div><section class="layout"><div class="inner">{{<div class="text story-text"><h1>The long way down</h1><h2>She climbed it twice and came back by another road</h2><p>At the hut they keep a book, and her name is in it four times, each in another hand.</p><p>The warden remembers the second visit best, since she paid for a bed and slept on the step.</p><p>Asked why, she said that the stars were on that side.</p>
<section class="chapter"><h3>North face</h3><p>Nobody had gone up by the north face in winter, and the rope was borrowed.</p></section><aside class="pullquote"><p>The rope was borrowed, and so was the day.</p></aside><p>What she saw from the top she has told to one person only, and he is not telling.</p></div>}}
<div class="follow social"><a href="/x">Follow us</a></div><div class="tags"><a href="/t1">mountains</a><a href="/t2">winter</a></div><div class="sponsor sponsored-content"><p>Paid for by a maker of boots</p></div></div><div class="rail widget"><div class="promotion">Win a tent</div><div class="advertisement">Boots for every foot</div></div></section>
<dialog><p>Session about to end</p></dialog><menu><li><button>Print</button></li></menu><footer class="legal copyright"><p>No part may be copied without leave</p></footer></body></html>"""

WIKI = """<html><head><title>Salt road</title></head><body class="mediawiki"><div id="siteNotice" class="site-notice"><p>Help us to keep this running</p></div><div id="mw-navigation" class="navigation"><div class="portal"><h3>Tools</h3><ul><li><a href="/w">What links here</a></li></ul></div></div>
{{<div id="bodyContent" class="mw-body content"><h1 id="firstHeading">Salt road</h1><div class="mw-parser-output"><p>A <b>salt road</b> is a road on which salt was carried from the pans to the towns inland.</p>}}<div id="toc" class="toc"><h2>Contents</h2><ul><li><a href="#1">Course</a></li></ul></div>{{<h2><span>Course</span></h2><p>From the coast it went over two passes, and the tolls on it paid for three castles.</p><ul><li>Lower pass, the shorter</li><li>Upper pass, open from May</li></ul><table class="wikitable"><tr><td>Toll</td><td>One penny a mule</td></tr></table><div class="reflist references"><ol><li>Account book of the abbey, folio nine</li></ol></div></div></div>}}
<div class="navbox"><a href="/r1">Amber road</a><a href="/r2">Silk road</a></div><div id="catlinks" class="catlinks"><a href="/c">Roads</a></div><div id="footer" role="contentinfo"><ul><li>This page was last changed in spring</li></ul></div></body></html>"""

PLAIN = """<html><head><title>Letter</title></head><body>{{<article><h1>To whoever has the boat now</h1><p>You will have seen that she leaks. It is the third plank, and it always was.</p><p>Fill it with tar in April and do not row her in a north wind.</p><header><h2>The oars</h2></header><p>They are not a pair. The <i>longer</i> goes left.</p><div><p>With good wishes for the summer.</p></div></article>}}<nav><a href="/l">More letters</a></nav><footer>Found in a drawer</footer><div class="ad">Boats bought for cash</div></body></html>"""

KITCHEN = """<!DOCTYPE html><html><head><title>Bread without kneading | Slow Kitchen</title></head><body class="post-template"><div class="container"><div class="top-bar"><a href="/">Slow Kitchen</a><a href="/r">Recipes</a><a href="/j">Join</a></div>
{{<article class="recipe"><div class="header"><h1 class="header">Bread without kneading</h1><p>Time does the work that hands are usually asked to do, and it costs nothing but a night.</p></div>
<p>Stir flour, water, salt and a pinch of yeast together until no dry flour is left in the bowl.</p>}}<div class="subscribe newsletter"><h3>Never miss a loaf</h3><p>Get our letter every Friday</p><form><input><button>Subscribe</button></form></div>{{
<div class="alert note"><p>Mind the pot when it comes out of the oven, for it stays hot longer than you think.</p></div>}}<div class="ads"><span class="ad">Promoted</span><a href="/k">Knives for less</a></div>{{
<p class="ad-hoc">If you have no pot with a lid, a tin turned over on a tray does nearly as well for a first try.</p><h2 class="header">What can go wrong</h2><ul><li>The dough is flat, since the night was cold.</li><li>The crust is soft, since the lid stayed on.</li></ul>
<div class="popular"><p>The most popular change is to take a third of rye, which makes the crumb darker and keeps it moist.</p></div>}}<div class="related-posts"><h3>Related posts</h3><ul><li><a href="/1">Rye in a tin</a></li><li><a href="/2">A starter in five days</a></li></ul></div>{{
<p>Wait an hour before you cut it, which is the hardest part of the whole recipe.</p>}}<div class="you-may-also-like"><h4>You may also like</h4><a href="/3">Soup from crusts</a> <a href="/4">Butter at home</a></div><div class="share-bar"><a href="/f">Share</a><a href="/t">Tweet</a></div>{{</article>}}
<section class="responses" id="responses"><h2>Responses</h2><div class="response"><b>Ola</b><p>Mine came out like a stone.</p></div><div class="response"><b>Per</b><p>Try it with less water next time.</p></div></section></div><div class="bottom"><a href="/about">About</a><a href="/terms">Terms</a></div></body></html>"""

REPORT = """<html><head><title>Ferry timetable study</title></head><body><table class="layout"><tr><td class="left-col"><a href="/a">Home</a><br><a href="/b">Studies</a><br><a href="/c">Staff</a><br><a href="/d">Contact</a></td><td>{{<h1>Ferry timetable study</h1><p>We counted passengers on four crossings for two weeks in spring, at all hours of the day.</p>
<p>The result surprised the company more than it surprised the people on the quay, who had long known it.</p><table class="data"><tr><th>Crossing</th><th>Passengers</th></tr><tr><td>North</td><td>1,204</td></tr><tr><td>South</td><td>986</td></tr></table>}}<div class="sponsored-links"><a href="/s1">Cabins by the sea</a> <a href="/s2">Cheap car hire</a></div>{{
<p>On Sundays the boats are full by nine, and those who come later wait for an hour in the wind.</p><div class="box"><p>A larger boat would help less than a second one, because the quay is where the time goes.</p></div>}}<table><tr><td><a href="/n1">Next study</a></td></tr><tr><td><a href="/n2">Bus lanes</a></td></tr><tr><td><a href="/n3">Night trains</a></td></tr></table></td></tr></table><div class="copyright">Institute of Quays, printed pages may be ordered</div></body></html>"""

LABELLED = (BLOG, NEWS, MANUAL, OLD, FORMS, FORUM, MAGAZINE, WIKI, PLAIN, KITCHEN, REPORT)
