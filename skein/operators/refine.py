"""Rewriting a request: dictionary expansion, particles, typo correction against the project's own words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Korean particles, longest first.
PARTICLES = (
    "에서", "으로", "부터", "까지", "하고", "이랑", "에는", "에도",
    "가", "이", "은", "는", "을", "를", "도", "만", "에", "로", "와", "과", "랑", "요",
)
# Development words and what to look for instead; results must be the same as with this table.
DICTIONARY = {
    "로그인": ("login", "signin", "auth"),
    "로그아웃": ("logout", "signout"),
    "인증": ("auth", "authenticate", "authentication"),
    "회원가입": ("signup", "register"),
    "가입": ("signup", "register"),
    "결제": ("payment", "billing", "charge", "checkout"),
    "비밀번호": ("password",),
    "암호": ("password", "encrypt"),
    "사용자": ("user", "account"),
    "계정": ("account", "user"),
    "토큰": ("token", "jwt"),
    "세션": ("session",),
    "데이터베이스": ("database",),
    "설정": ("config", "settings", "setup"),
    "오류": ("error", "exception"),
    "에러": ("error", "exception"),
    "검색": ("search", "query", "find"),
    "지갑": ("wallet",),
    "거래": ("transaction", "trade"),
    "잔액": ("balance",),
    "코인": ("coin", "token"),
    "네트워크": ("network",),
    "알림": ("notification", "alert"),
    "업로드": ("upload",),
    "다운로드": ("download",),
    "프로필": ("profile",),
    "대시보드": ("dashboard",),
    "삭제": ("delete", "remove"),
    "추가": ("add", "insert", "create"),
    "저장": ("save", "store", "persist"),
    "불러오기": ("load", "fetch", "read"),
    "목록": ("list",),
    "리스트": ("list",),
    "화면": ("view", "screen", "page"),
    "페이지": ("page", "view"),
    "버튼": ("button",),
    "메뉴": ("menu",),
    "이미지": ("image", "photo"),
    "사진": ("photo", "image"),
    "파일": ("file",),
    "폴더": ("folder", "directory"),
    "주문": ("order",),
    "장바구니": ("cart", "basket"),
    "배송": ("shipping", "delivery"),
    "리뷰": ("review",),
    "댓글": ("comment", "reply"),
    "게시글": ("post", "article"),
    "게시판": ("board", "post"),
    "채팅": ("chat", "message"),
    "메시지": ("message",),
    "친구": ("friend",),
    "팔로우": ("follow",),
    "좋아요": ("like", "favorite"),
    "즐겨찾기": ("favorite", "bookmark"),
    "통계": ("stats", "statistics", "analytics"),
    "그래프": ("graph", "chart"),
    "차트": ("chart", "graph"),
    "로그": ("log", "logging"),
    "캐시": ("cache",),
    "백업": ("backup",),
    "동기화": ("sync", "synchronize"),
    "권한": ("permission", "auth", "role"),
    "보안": ("security", "secure"),
    "테스트": ("test",),
    "빌드": ("build",),
    "배포": ("deploy", "release"),
    "성능": ("performance", "perf"),
    "속도": ("speed", "performance"),
    "메모리": ("memory",),
    "애니메이션": ("animation", "animate"),
    "아이콘": ("icon",),
    "색상": ("color", "theme"),
    "색깔": ("color",),
    "폰트": ("font", "typography"),
    "날짜": ("date",),
    "시간": ("time", "date"),
    "위치": ("location", "position"),
    "지도": ("map",),
    "카메라": ("camera",),
    "번역": ("translate", "localization", "i18n"),
    "언어": ("language", "locale"),
    "다크모드": ("dark", "theme", "appearance"),
    "테마": ("theme", "appearance"),
    "환불": ("refund",),
    "쿠폰": ("coupon", "discount"),
    "할인": ("discount", "sale"),
    "포인트": ("point", "reward"),
    "재고": ("stock", "inventory"),
    "상품": ("product", "item"),
    "가격": ("price", "cost"),
    "요청": ("request",),
    "응답": ("response",),
    "서버": ("server", "api"),
    "클라이언트": ("client",),
    "연결": ("connect", "connection"),
    "느림": ("slow", "performance"),
    "느려": ("slow", "performance"),
    "깨짐": ("broken", "crash", "bug"),
    "깨져": ("broken", "crash", "bug"),
    "튕김": ("crash",),
    "튕겨": ("crash",),
    "멈춤": ("hang", "freeze", "crash"),
    "멈춰": ("hang", "freeze", "crash"),
    "충돌": ("crash", "conflict"),
    "버그": ("bug", "fix", "error"),
    "수정": ("fix", "update", "edit"),
    "리팩토링": ("refactor",),
    "최적화": ("optimize", "performance"),
    "마스코트": ("mascot",),
    "훅": ("hook",),
    "커밋": ("commit",),
    "브랜치": ("branch",),
    "정렬": ("sort", "order"),
    "필터": ("filter",),
    "변환": ("convert", "transform", "parse"),
    "유효성": ("validation", "validate"),
    "검증": ("validate", "verify"),
    "초기화": ("init", "reset", "initialize"),
    "상태": ("state", "status"),
    "이벤트": ("event",),
    "클릭": ("click", "tap"),
    "입력": ("input",),
    "출력": ("output",),
    "스크롤": ("scroll",),
    "새로고침": ("refresh", "reload"),
    "모달": ("modal", "dialog"),
    "팝업": ("popup", "modal"),
    "토글": ("toggle",),
    "로딩": ("loading", "spinner"),
    "진행률": ("progress",),
    "큐": ("queue",),
    "스택": ("stack",),
    "노드": ("node",),
    "라우팅": ("routing", "route", "router"),
    "라우트": ("route", "router"),
    "쿠키": ("cookie",),
    "헤더": ("header",),
    "인덱스": ("index",),
    "쿼리": ("query",),
    "스키마": ("schema",),
    "마이그레이션": ("migration", "migrate"),
    "구독": ("subscribe", "subscription"),
    "웹소켓": ("websocket", "socket"),
    "소켓": ("socket",),
    "폼": ("form",),
    "필드": ("field",),
    "탭": ("tab",),
    "사이드바": ("sidebar",),
    "네비게이션": ("navigation", "navbar"),
    "라이브러리": ("library", "dependency"),
    "의존성": ("dependency",),
    "패키지": ("package",),
    "모듈": ("module",),
    "컴포넌트": ("component",),
    "훅스": ("hook", "hooks"),
    "signin": ("login", "auth"),
    "auth": ("authenticate", "authentication", "login"),
    "db": ("database",),
    "config": ("settings", "config"),
    "pw": ("password",),
    "img": ("image",),
    "btn": ("button",),
    "msg": ("message",),
    "nav": ("navigation", "navbar"),
    "api": ("api", "endpoint", "server"),
    "ui": ("view", "interface", "screen"),
    "crash": ("crash", "exception", "fatal"),
}


def dictionary_words(term: Column) -> Column:
    """Words for a term, or for it without its longest particle that leaves a known one; null if there are none."""
    table = F.create_map(*[x for key, words in DICTIONARY.items() for x in (F.lit(key), F.array(*map(F.lit, words)))])
    tries = [F.try_element_at(table, term)]
    for particle in PARTICLES:
        cut = F.when(term.endswith(particle) & (F.char_length(term) > len(particle)), F.expr("substring(%s, 1, char_length(%s) - %d)" % (("__term",) * 2 + (len(particle),))))
        tries.append(F.try_element_at(table, F.coalesce(cut, F.lit(""))))
    return F.coalesce(*tries)


def deletions(word: Column, most: int) -> Column:
    """The word and every word left by taking out up to ``most`` (1 or 2) of its characters."""
    drop = lambda w: F.transform(F.sequence(F.lit(1), F.char_length(w)), lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1)))
    once = drop(word)
    found = F.concat(F.array(word), once)
    if most == 2:
        found = F.concat(found, F.flatten(F.transform(F.filter(once, lambda w: F.char_length(w) > 0), drop)))
    return F.array_distinct(found)


def corrections(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(term, fix): the one closest word of the vocabulary, within distance 1, or 2 from six characters on.

    Terms that are words of the vocabulary, terms under three characters and terms with several closest words get none.
    Two words within a distance share a word left by that many deletions, so candidates come from an equality join.  It is
    also on the length of the term, which lies within the distance of the word's: words take out one letter for terms under
    six characters and two for longer ones, so short keys don't bring words of all lengths together.
    """
    t = terms.select("term").distinct().where("char_length(term) >= 3")
    t = t.join(vocabulary.select(F.col("word").alias("term")).distinct(), "term", "left_anti")
    size = F.char_length("term")
    reach = F.when(size >= 6, deletions(F.col("term"), 2)).otherwise(deletions(F.col("term"), 1))
    left = t.select("term", size.alias("size"), F.explode(reach).alias("key"))
    words = vocabulary.select("word").distinct().withColumn("n", F.char_length("word")).where("n >= 2")
    sizes = lambda most, low, high: F.filter(F.sequence(F.col("n") - most, F.col("n") + most), lambda s: s.between(low, high))
    short = words.where("n <= 6").select("word", F.explode(sizes(1, 3, 5)).alias("size"), deletions(F.col("word"), 1).alias("keys"))
    longer = words.where("n >= 4").select("word", F.explode(sizes(2, 6, 2**30)).alias("size"), deletions(F.col("word"), 2).alias("keys"))
    right = short.unionByName(longer).select("word", "size", F.explode("keys").alias("key"))
    pairs = left.join(right, ["key", "size"]).select("term", "word").distinct()
    limit = F.when(F.char_length("term") >= 6, 2).otherwise(1)
    near = pairs.withColumn("d", F.levenshtein("term", "word")).where((F.col("d") > 0) & (F.col("d") <= limit))
    least = near.groupBy("term").agg(F.min_by(F.struct("d", "word"), F.struct("d", "word")).alias("b"), F.collect_list("d").alias("all"))
    return least.where(F.size(F.filter("all", lambda d: d == F.col("b.d"))) == 1).select("term", F.col("b.word").alias("fix"))


def refined_terms(requests: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(request_id, terms): each request's terms, expanded by the dictionary, corrected or kept, without repeats.

    An expanded English term stays after its words; the order of first use is kept.
    """
    terms = requests.select("request_id", F.posexplode(T.query_terms(F.col("text"))).alias("at", "term"))
    mapped = terms.withColumn("__term", F.col("term")).withColumn("words", dictionary_words(F.col("__term"))).drop("__term")
    fixes = corrections(mapped.where("words is null").select("term"), vocabulary)
    ascii_only = ~F.col("term").rlike(r"[^\x00-\x7F]")
    own = F.when(ascii_only, F.array("term")).otherwise(F.array().cast("array<string>"))
    out = mapped.join(fixes, "term", "left").select("request_id", "at", F.when(F.col("words").isNotNull(), F.concat("words", own)).otherwise(F.array(F.coalesce("fix", "term"))).alias("w"))
    ordered = out.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("at", "w"))).alias("all"))
    return ordered.select("request_id", F.array_distinct(F.flatten(F.transform("all", lambda x: x["w"]))).alias("terms"))
