"""A small labelled table of invented URLs: pages that a corpus wants, and pages that it doesn't."""

WANTED = """
https://library.elmford.org/catalogue/records/1843-harvest-ledger
https://www.brackenmuseum.net/exhibits/bronze-age-tools
http://physics.northvale.org/lectures/thermodynamics/week-3.html
https://kitchen-notes.com/recipes/slow-roasted-fennel
https://gardenersalmanac.net/2019/04/pruning-old-pear-trees
https://docs.quillstack.org/reference/string-functions
https://docs.hexparse.com/guide/getting-started
https://en.openatlas.org/wiki/Glacial_lake
https://de.openatlas.org/wiki/Gletschersee
https://fr.openatlas.org/wiki/Lac_glaciaire
https://es.openatlas.org/wiki/Lago_glaciar
https://www.dailyherald-online.com/world/elections-explained
https://regionalpost.net/news/2021/07/12/bridge-reopens
http://history.westmoor.net/essays/the-salt-road
https://journals.meridianpress.org/biology/vol12/issue3/mosses
https://arxivmirror.org/abs/1806.04411
https://mathnotes.org/algebra/galois-theory.pdf
https://www.riverhealth.org/patients/asthma-guide
https://clinicguide.com/conditions/migraine/treatment
https://weather.coastwatch.net/forecast/northern-isles
https://www.stationmaster.org/timetables/branch-line-history
https://school.larchwood.org/curriculum/year-9/geography
https://teachersroom.com/worksheets/fractions
https://philosophyreader.org/articles/on-doubt
https://booksandmore.com/reviews/a-winter-in-turku
https://translation-forum.org/threads/idioms-of-the-sea
https://forum.woodcraft.net/threads/dovetail-joints.2231
https://askengineers.org/questions/4412/why-do-bridges-hum
https://community.birdlife-notes.org/t/heron-colonies/88
https://blog.slowtravel.net/2016/walking-the-old-border
https://astronomyclub.org/observing/saturn-2023.html
https://www.parliament-records.org/debates/1974/march
https://legaltexts.net/acts/tenancy-act/section-4
https://statistics.harrow.org/tables/population-by-age
https://musicarchive.org/scores/string-quartet-no-2
https://www.filmjournal.com/interviews/the-editor-at-work
https://opensourcediary.com/posts/profiling-a-parser
https://code.tinkerbench.org/projects/sensor-logger/readme
https://wiki.sailmaker.net/rigging/splices
https://chemistry.ostwald.org/safety/handling-acids
https://languagelab.org/grammar/subjunctive-in-spanish
https://worldfacts.net/countries/uruguay/economy
https://www.farmersfield.com/soil/crop-rotation-basics
https://conservation.moorland.org/reports/peat-survey-2020.pdf
https://children.storytree.org/tales/the-clever-crow
https://architecturereview.net/buildings/granary-conversion
https://cyclingnotes.com/maintenance/truing-a-wheel
https://www.chessannotated.org/games/1927/round-11
https://podcast.earlymusic.net/episodes/the-viol/transcript
https://engineering.bytefold.com/articles/consistent-hashing
https://universitypress.net/open-access/chapters/urban-rivers
https://www.citizenadvice-guide.org/housing/deposits
https://geology.fieldtrips.org/sites/limestone-pavement
https://economics101.net/lessons/inflation
https://cooking.grandmothersbook.com/bread/rye-sourdough
https://newsroom.stadtanzeiger.net/kultur/theaterpremiere
https://www.lemagazinelocal.com/societe/transport-scolaire
https://noticiasdelvalle.net/cultura/feria-del-libro
https://biblioteca.sanmartin.org/catalogo/mapas-antiguos
https://lexikon.pflanzenkunde.net/farne/wurmfarn
""".split()
UNWANTED = """
https://lucky-spin-palace.com/welcome-bonus/claim
http://best-slots-24.net/go.php?ref=88121
https://megajackpot.casino-royal-win.com/deposit/free-spins
https://poker-cash-now.net/signup?aff=301
https://betting-tips-sure.com/win/1x2/today
https://cheap-meds-online.net/buy/no-prescription
http://rx-pills-discount.com/order.php?id=77
https://bluepill-store.com/cart/checkout?promo=50off
https://hot-singles-tonight.net/chat/join
https://xxxlivecams.com/room/free-preview
http://adult-tube-free.net/watch?v=99812
https://sexy-dates-now.com/profile/click
https://download-crack-full.net/keygen/serial.exe
https://warez-mirror.com/torrent/get.php?f=setup
http://free-movies-hd-stream.net/player/watch-online-free
https://torrentzone-proxy.com/magnet/latest
https://win-a-phone-today.com/prize/claim-now
http://you-are-winner.net/survey/step1.php
https://free-giftcards-generator.com/verify/human
https://get-followers-fast.net/buy/10000-likes
https://seo-backlinks-cheap.com/packages/5000-links
http://traffic-exchange-click.net/ptc/ads?id=12
https://quick-payday-cash.com/apply/no-credit-check
https://instant-loan-approval.net/lead/form.php
https://forex-robot-profit.com/signals/join-vip
https://crypto-doubler-fast.net/invest/send-btc
http://earn-money-at-home-fast.com/secret/system
https://make-10k-weekly.net/landing?utm=spam7
https://replica-watches-outlet.com/rolex/sale-80
https://fake-designer-bags.net/shop/cheap
https://lose-weight-miracle.com/order/ketogummies
http://anti-aging-secret-trick.net/doctors-hate-this
https://clickbait-viral-buzz.com/you-wont-believe/17
https://shocking-celebs-exposed.net/gallery/next?p=2
http://adserver-track.com/redirect.php?url=aHR0cA
https://popunder-network.net/serve/banner?zone=4
https://login-verify-account.com/secure/update.php
http://paypa1-support-center.net/signin/confirm
https://bank-alert-unlock.com/verify/card
https://prize-delivery-parcel.net/track/pay-fee
https://casino-bonus-ohne-einzahlung.net/freispiele
https://jeux-casino-argent-gratuit.com/bonus/inscription
https://apuestas-seguras-gratis.net/registro?bono=100
https://essay-writers-cheap.com/order/pay
https://buy-diploma-online.net/degrees/fast
https://spin-and-win-slots.com/lobby/play
https://vip-escort-directory.net/city/models
https://nude-leaks-hub.com/download.zip
http://driver-update-free-pc.net/install/setup.exe
https://pc-cleaner-boost.com/download/free-scan
http://apk-mod-unlimited.net/hack/coins-generator
https://game-cheats-hack.com/generator/no-survey
https://tarot-love-spells-cast.net/order-now
https://miracle-hair-growth.com/buy-2-get-1
https://stream-sports-live-free.net/channel7/play.php
https://pirated-ebooks-free.com/dl/123456
https://domain-parked-ads.net/?kw=insurance
https://cheap-insurance-quotes-now.com/lead?sid=9
http://click-here-to-win.net/iphone/claim.php
https://bestdeals-coupon-spam.com/out/9981
""".split()
