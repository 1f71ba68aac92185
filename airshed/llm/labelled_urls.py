"""A small labelled url table: what the learned verdict of :mod:`airshed.llm.urls` is trained on by default.

Labels were given url by url.  Evidence lies in host words, in how hosts are
put together (bait words joined by hyphens, throw-away top-level domains,
digits for letters) and in paths (click trackers, redirects, order forms);
wanted urls have hyphens, languages, numbers and subdomains too, so that none
of these alone decides.  :func:`composed` adds hosts built by rule from words of both kinds.
"""

BLOCK = """
http://www.lucky-casino.example.com/en/12
https://casino-royal777.example.net/slots/bonus
http://play-casino.example.org/de/4
http://m.mega-casino.example.com/fr/61.html
https://poker-stars-win.example.com/en/800
http://www.win-big-poker.example.net/join
https://free-slots.example.org/spin/now
http://best-bets.example.com/odds/today
https://www.sure-bets24.example.net/en/33/
http://bets-online.example.org/es/77
http://free-lottery.example.com/ticket/win
https://m.lottery-win.example.net/en/5
http://jackpot-now.example.org/claim/prize
http://roulette-vip.example.com/bonus/100
https://cheap-meds.example.com/order/now
http://www.cheap-viagra.example.net/en/9
https://pills-online.example.org/buy/cheap
http://blog.buy-pills.example.com/en/345
https://www.diet-pills.example.net/order/form
http://no-rx-pharmacy.example.org/buy/now
https://cheap-watches.example.com/replica/12
http://replica-bags.example.net/buy/77
https://www.cheap-loans.example.org/apply/now
http://fast-cash-loans.example.com/en/1
https://adult-cams.example.com/live/now
http://www.adult-dating.example.net/join/free
https://m.adult-video.example.org/en/44
http://xxx-tube.example.com/watch/18
https://free-xxx.example.net/en/6
http://hot-porn.example.org/video/91
https://porn-hd.example.com/fr/3
http://sexy-cams.example.net/live/5
https://x-rated.example.org/en/70
http://spam-mail.example.com/list/buy
https://www.spam-king.example.net/en/21
http://link-farm.example.org/out/93
https://m.link-farm7.example.com/links/1
http://seo-spam.example.net/backlink/buy
https://buy-links.example.org/seo/cheap
http://ads-server.example.com/banner/12
https://www.ads-click.example.net/en/88
http://pop-ads.example.org/popunder/1
https://m.ads-net.example.com/click/track/9
http://track-click.example.net/r/77
https://click-track.example.org/redirect/5
http://pixel-track.example.com/pixel/1
https://adtracker.example.net/click/out/8
http://warez-crack.example.org/keygen/3
https://www.free-crack.example.com/download/serial
http://keygen-full.example.net/crack/now
http://get-rich.example.top/signup/bonus
https://win-iphone.example.click/claim/prize
http://fr33-c4sino.example.xyz/bonus/1
https://v1agra.example.top/buy/now
http://lose-weight-fast.example.click/order/now
https://miracle-diet.example.xyz/buy/cheap
http://secure-login-verify.example.top/account/verify
https://bank-update.example.click/login/verify
http://prize-claim.example.xyz/claim/now
https://crypto-double.example.top/bonus/claim
http://quasto.example.com/click/out/33
https://belmir.example.net/redirect/offer/2
http://www.torvan.example.org/track/click/18
https://ludrin.example.com/popunder/banner/7
http://m.harkes.example.net/buy/cheap/now
https://pavlo.example.org/claim/prize/1
http://sondre.example.com/order/now/bonus
https://wexley.example.net/casino/bonus/4
http://brimco.example.org/out/affiliate/12
https://daltis.example.com/affiliate/click/3
http://norvik.example.net/promo/bonus/claim
https://gemlit.example.org/download/crack/9
http://kestor.example.com/replica/cheap/8
https://olvane.example.net/live/cams/xxx
http://trisk.example.org/pills/order/now
""".split()

ALLOW = """
http://www.city-library.example.org/en/12
https://north-museum.example.com/visit/hours
http://blog.green-garden.example.net/en/345
https://m.weather-report.example.org/de/7
http://www.history-society.example.com/articles/55
https://open-courses.example.net/lessons/3
http://river-town.example.org/council/minutes/9
https://science-news.example.com/en/800
http://art-school.example.net/fr/61.html
https://book-club.example.org/reviews/18
http://bird-watch.example.com/species/42
https://www.cook-book.example.net/recipes/soup/5
http://rail-map.example.org/lines/2
https://health-service.example.com/advice/sleep
http://tax-office.example.net/forms/2019
https://chess-club.example.org/games/91
http://www.astro-notes.example.com/en/33/
https://old-maps.example.net/es/77
http://film-archive.example.org/en/5
https://music-theory.example.com/lessons/chords
http://farm-school.example.net/animals/3
https://link-library.example.org/catalog/8
http://track-and-field.example.com/results/12
https://free-software.example.net/manual/install
http://www.free-press.example.org/en/21
https://adult-education.example.com/courses/4
http://winter-sports.example.net/news/6
https://blog.example.com/en/44
http://www.example.org/about
https://docs.example.net/guide/start
http://wiki.example.com/page/71
https://news.example.org/world/2020/5
http://shop.example.net/products/book/9
https://m.example.com/fr/3
http://therin.example.com/en/770
https://www.thanor.example.net/en/1
http://m.ouraton.example.org/fr/93
https://blog.anderil.example.com/de/88
http://ingtha.example.net/en/70
https://eredon.example.org/es/6.html
http://www.heston.example.com/en/128/
https://tionare.example.net/fr/12
http://blog.stomer.example.org/en/4
https://m.erthing.example.com/en/61.html
http://onthean.example.net/de/800
https://batherle.example.org/en/9/
http://wharen.example.com/es/345
https://www.shating.example.net/en/72
http://blog.ventier.example.org/fr/18
https://m.keitung.example.com/de/5
http://cionado.example.net/es/44/
https://reandor.example.org/en/91
http://blemaris.example.com/articles/12
https://www.toliver.example.net/notes/7
http://quenby.example.org/research/paper/3
https://aldwin.example.com/photos/2018
http://m.fenwick.example.net/recipes/8
https://corbel.example.org/history/roman
http://blog.istria.example.com/travel/italy
https://hollin.example.net/docs/api/index
http://www.marlow.example.org/contact
https://pendry.example.com/lessons/12
http://rosten.example.net/manual/chapter/2
https://savile.example.org/library/catalog
http://tarrant.example.com/news/local/77
https://m.ulmer.example.net/weather/today
http://vandel.example.org/species/fern
https://www.wendle.example.com/reviews/31
http://yarrow.example.net/council/2021
https://zennor.example.org/maps/coast
http://blog.cheapside.example.com/en/55
https://essex-farm.example.net/en/28
http://sussex-track.example.org/results/3
https://alphabets.example.com/en/17
http://heads-up.example.net/en/66
""".split()

BAIT = ("adult porn sexcam casino poker bets lottery jackpot slots pills viagra pharma cheap loans payday replica warez "
        "crack keygen spam seolinks linkfarm ads adserver tracker popunder clickbait phishing").split()
PLAIN = ("library museum garden school history science weather council poetry railway kitchen orchestra forest harbour "
         "village astronomy grammar cinema theatre climbing gallery university hospital recipes cycling sailing geology "
         "pottery knitting archive").split()
SHAPES = ("{w}", "{w}-{o}", "{o}-{w}", "{w}{o}", "{w}-{n}")
OTHERS = "farm win free online x track best club net home world now".split()
SUBDOMAINS = ("", "www.", "m.", "blog.")
SYLLABLES = "ba de fi go hu ka le mi no pu ra se ti vo wa ch th sh er in on an at ed es ou re le st en".split()


def composed(bait: list[str], plain: list[str]) -> list[tuple[str, str]]:
    """Every word in every shape, on equal paths for both labels; and as many hosts of plain syllables."""
    out = []
    for label, words in (("block", bait), ("allow", plain), ("allow", None)):
        for i in range(len(words or bait)):
            for k, shape in enumerate(SHAPES):
                n = i * len(SHAPES) + k
                word = words[i] if words else "".join(SYLLABLES[(n * m + m) % len(SYLLABLES)] for m in (7, 11, 13))
                # plain syllables stand alone; words meet the same company under both labels
                name = shape.format(w=word, o=OTHERS[n % len(OTHERS)], n=n) if words else word
                host = f"{SUBDOMAINS[n % 4]}{name}.example.{('com', 'net', 'org')[n % 3]}"
                out.append((f"http://{host}/{('en', 'de', 'fr', 'es')[n // 4 % 4]}/{n}{('', '/', '.html')[n // 3 % 3]}", label))
    return out


LABELLED = [(url, "block") for url in BLOCK] + [(url, "allow") for url in ALLOW] + composed(BAIT, PLAIN)
