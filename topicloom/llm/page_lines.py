"""What the lines of page texts are: surroundings of an article, its body, or a text that is none.

One pass over the contents serves problems 2, 3 and 5. Each line is put into a class by its form and by
phrases; lines that the record's site repeats (problem 1) count as surroundings whatever their words.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from dataclasses import dataclass, field
from itertools import accumulate

from .screens import Screened
from .text_statistics import measure, repeated_grams

# Words of menus and of footers.
MENU_WORDS = frozenset(
    "首页 快讯 资讯 数据 报告 专题 活动 会展 视频 直播 问答 论坛 人物 图库 招聘 商城 订阅 登录 注册 下载 手机版 企业库 会员中心 行情 政策 英文版 english 栏目 频道 新闻 财经 科技 搜索 更多 客户端 导航 "
    "home markets data reports opinion topics archive latest jobs newsletter shop register mobile glossary video events forums subscribe log_in login search menu news".split()
)
FOOTER_WORDS = frozenset(
    "联系我们 关于我们 法律声明 隐私政策 广告服务 服务条款 友情链接 举报中心 网站地图 意见反馈 版权合作 招聘信息 投稿指南 查看全部 加入我们 帮助中心 用户协议 免责声明 版权声明 "
    "contact about_us privacy_policy terms_of_use press_office feedback sitemap accessibility advertise careers help imprint legal cookie_policy".split()
)
_TWO_WORDS = [(re.compile(w.replace("_", " ")), w) for w in (*MENU_WORDS, *FOOTER_WORDS) if "_" in w]

#: Characters from which a line is long.
LONG = 170
_MENU_MARK = re.compile(r"[|/·»›>]")
_SPLIT = re.compile(r"[|/·»›>–—•,、;:\-\s]+")
_EDGE = re.compile(r"^[\s\[\]【】()<>«»*•·●○■□▪◆▼▲|#=~—–\-_.。…!?]+|[\s\[\]【】()<>«»*•·●■□▪◆▼▲|#=~—–\-_]+$")
_NOISE = re.compile("[\u0000-\u0008\u000b-\u001f\u007f­​-‏‪-‮⁠-⁤︀-️﻿]")
_SENTENCE_END = re.compile(r"(?:[。.!?…:;][\"'”’」』)\]]*|\((?:全文|更多|原文|阅读全文|查看全文)[^()]{0,8}\))\s*$")
_INNER_END = re.compile(r"[。!?]")
_HAN = re.compile(r"[㐀-鿿豈-﫿]")
_LATIN_WORD = re.compile(r"[a-z]+(?:['’-][a-z]+)*")
_NUMBER = re.compile(r"^[+\-]?\d[\d,.]*%?$")

_DATE = r"\d{2,4}[-/.年]\d{1,2}(?:[-/.月]\d{1,2}日?)?"
# Phrases of the surroundings, on lower-cased NFKC text without ornaments at its ends.
SURROUNDINGS = {
    "crumb": re.compile(r"^(?:当前位置|您的位置|所在位置|位置)\s*:|^(?:首页|home)\s*[/>»›]|^[\w ]{1,16}(?:频道)?\s*(?:>>|»)\s*\w|you are here:"),
    "cookie": re.compile(r"cookie|小型文本文件|keeps? small files|uses? small files|\[接受\]|全部接受|仅必要项|accept all"),
    "share": re.compile(
        r"^扫一扫|长按识别|二维码|公众号|转发到|分享给|分享到|一键分享|^转发:|^分享:|微群|稍后读|复制链接|^share (?:via|this|on)|^enjoyed this|pass it on|\bshares?\)|^下载.{1,30}app|^打开.{1,30}客户端|点击进入.{1,30}专题|接收推送|^觉得有用|^喜欢这篇|^看完别忘|^follow .{1,40} (?:for|on)\b|follow us|^(?:subscribe to|sign up for)\b|订阅本站"
    ),
    "source": re.compile(rf"^来源:|发布时间:|字号:|浏览量:|^{_DATE}\s+\d{{1,2}}:\d{{2}}\s*来源|阅读\s*\d+$|^.{{1,40}}讯\s*{_DATE}|·\s*[\d,]+\s*min read|^source:|^published(?: on)? |稿源:"),
    "byline": re.compile(r"^责任编辑|^本期责编|^责编|^编辑[ :]|^作者:|^记者[ :]|^文[/|]|校对\s*\d|工号\s*\d|^by (?:desk|staff|our) |^by [a-z]\. ?[a-z]+$|^written by|^reporting:|editing:|^edited by"),
    "legal": re.compile(
        r"^(?:郑重|免责|特别|版权|重要)(?:声明|说明|提示)|^风险提示|未经.{0,8}(?:许可|授权).{0,6}(?:不得|禁止)|^凡(?:注明|本站)|^欢迎各方引用|^任何机构使用|编辑部保留|依法追究|(?:授权|经)发布.{0,20}版权|版权归.{1,30}所有|不构成.{0,12}建议|"
        r"^all material on|^reproduction in any|may not be republished|requires written permission|accepts no liability|^corrections should reach|all rights reserved|^copyright\b|^\(c\)\s*\d{4}|^c\)\s*\d{4}|^©|icp备|^版权所有"
    ),
    "comment": re.compile(r"^网友评论|人参与讨论|条评论|参与评论|\d+ 评论|readers? commented|\bcomments? \(\d|\d+ comments?|to join$"),
    "neighbour": re.compile(r"^(?:上一篇|下一篇|上篇|下篇|previous|next)\s*:"),
    "advert": re.compile(r"^(?:广告|推荐|热点|延伸阅读|相关阅读|点击查看|更多阅读|推广|赞助|related|see also|read more|editor's pick|sponsored|advertisement|recommended)(?:\s*[\]】:|\-—>]+|\s+)\s*\S"),
}
_ANY_SURROUNDING = re.compile("|".join(f"(?P<{kind}>{p.pattern})" for kind, p in SURROUNDINGS.items()))
# A literal of every alternative above: lines without one need no closer look.
TRIGGERS = (
    "位置 首页 home > » › here: cookie 小型文本文件 small&files [接受] 全部接受 必要项 accept&all 扫一扫 识别 二维码 公众号 转发到 转发: 分享给 分享到 分享: 一键分享 微群 稍后读 复制链接 share pass&it&on enjoyed 下载 打开 点击进入 推送 觉得有用 喜欢这篇 看完别忘 follow& subscribe&to sign&up&for 订阅本站 "
    "来源 发布时间 字号 浏览量 阅读 讯& min&read source: published 稿源 责任编辑 责编 编辑: 编辑& 作者: 记者 文/ 文| 校对 工号 by&  written&by reporting: editing: edited&by "
    "郑重声明 郑重说明 郑重提示 免责声明 免责说明 特别声明 特别说明 特别提示 版权声明 版权说明 重要声明 重要说明 重要提示 风险提示 未经 凡注明 凡本站 欢迎各方引用 任何机构使用 编辑部保留 追究 版权 不构成 "
    "all&material reproduction republished written&permission liability corrections&should rights&reserved copyright (c) c) © icp备 评论 参与讨论 comment to&join "
    "上一篇 下一篇 上篇 下篇 previous next 广告 推荐 热点 延伸阅读 相关阅读 更多阅读 点击查看 推广 赞助 related see&also read&more editor's&pick sponsored advertisement recommended"
).split()
TRIGGERS = tuple(t.replace("&", " ") for t in TRIGGERS)
_ANY_TRIGGER = re.compile("|".join(map(re.escape, TRIGGERS)))


def _triggers():
    """Tells the places at which triggers end; by an automaton where there is one."""
    try:
        import ahocorasick
    except ImportError:
        return lambda text: [m.end() - 1 for m in _ANY_TRIGGER.finditer(text)]
    automaton = ahocorasick.Automaton()
    for trigger in TRIGGERS:
        automaton.add_word(trigger, 0)
    automaton.make_automaton()
    return lambda text: [end for end, _ in automaton.iter(text)]


_trigger_ends = _triggers()
_HEADING = re.compile(
    r"^(?:编辑推荐|热门排行|热门推荐|相关推荐|相关新闻|猜你喜欢|大家都在看|点击榜|排行榜|最新文章|最新资讯|本周最受关注|更多.{1,12}内容|.{1,12}(?:最新|热榜|频道精选|排行)|readers also viewed|trending now|from the archive|you may also like|most read|more in [a-z ]+|top [a-z ]+ stories|latest stories|related stories|(?:popular|latest|more|trending|top|best) in .{1,30})$"
)
_ITEM = re.compile(r"^\s*(?:[\[(]?\d{1,3}[\])]?[.、:,)]?\s+|[·•●*▪■\-–—]+\s*|\d{1,2}-\d{1,2}\s+|\[\d{1,2}-\d{1,2}\]\s*|#\d+\s+)?")

# Messages in place of an article. Strong: enough by themselves; weak: only where the same masked line recurs across sources.
STRONG = Screened(
    r"网关超时|服务器(?:开小差|错误|繁忙|内部错误|异常)|访问(?:过于频繁|受限|被拒绝|被拦截|受到限制)|(?:页面|栏目|资源|文章|内容|链接|网页|地址|服务|文档|稿件).{0,12}(?:不存在|没有找到|未找到|响应超时|已过期|正在维护|维护中|已下线|下线了|已删除|被删除|找不到|无法显示|无法访问|打不开|加载失败|已失效|失效|不可用|出错|出现异常|已移除|走丢|迁移|需要.{0,6}权限)|"
    r"没有(?:权限|访问权限)|无权(?:访问|查看)|更高权限|网络(?:异常|错误|连接失败)|正在加载|加载中|秒后(?:自动)?跳转|未在规定时间内响应|(?:请求|错误|追踪)(?:编号|代码|码)\s*:?\s*[0-9a-f]|参数错误|系统(?:错误|繁忙|异常|维护)|(?:暂停|停止)服务|"
    r"(?:禁用|拦截|未启用|不支持|未开启|关闭|启用|开启|打开|允许|需要|要求).{0,8}(?:脚本|(?<![a-z])js(?![a-z])|javascript)|(?:脚本|javascript|(?<![a-z])js(?![a-z])).{0,10}(?:禁用|拦截|被阻止|未启用|不支持|未开启|关闭)|"
    r"\b(?:page|document|article|link|resource|service|server|portal|request|item|content|file|url|site|app)\b.{0,48}\b(?:not found|timed out|(?:is )?not responding|refused the connection|(?:is )?(?:temporarily )?down for maintenance|(?:is |was )?no longer available|has (?:been )?(?:re)?moved|not available|failed to load|unexpected response|was blocked|does not exist|doesn't exist|could not be (?:found|loaded)|doesn't work|temporarily unavailable)|"
    r"\b(?:access denied|too many requests|bad gateway|gateway time-?out|service (?:temporarily )?unavailable|internal server error|permission denied|forbidden|unauthorized|bad request|not acceptable|request timeout)\b|^http status \d{3}|^(?:error\s*)?[45]\d\d\b.{0,40}$|^error\s*\d*\s*:|"
    r"\btraceback \(|^file \".*\", line \d|^at [a-z_$][\w$.]*\(|\bsqlstate\[|^warning: \w+\(|^(?:\w+\.)*\w*(?:error|exception)\b\s*(?::|$)|^in module \w+ at line|too many connections|^fatal error|stack trace|core dumped|"
    r"^\{\s*\"(?:code|error|status|msg|message)\"|^<(?:!doctype|html|head|body|center|h1|hr|title)\b|^webfront/|^nginx/|^reference:\s*[0-9a-f]{6}|^request id|\bray (?:id)?\s*:?\s*[0-9a-f]{6}|checking your (?:connection|browser)|"
    r"\b(?:enable|turn on|allow|activate|requires?|need)\b.{0,24}\b(?:javascript|js|scripts?|scripting)\b|\b(?:javascript|scripts?|scripting|js)\b.{0,16}\b(?:is|are|has been)\b.{0,12}\b(?:disabled|switched off|turned off|blocked|required|off)\b|without (?:javascript|js) enabled|^noscript\b|"
    r"^エラー|見つかりません|no se encuentra|introuvable|nicht gefunden|non trovata|не найдена|찾을 수 없|"
    r"占位(?:文本|文字|内容)|待编辑|请输入正文|段落文字|示例文字|排版预览|样张|尚未录入|暂无内容|填写正文|正式上线前|请勿发布|测试稿|placeholder text|sample copy|to be written|replace before launch|insert text here|your text here|text goes here"
)
WEAK = Screened(r"^(?:抱歉|对不起|很遗憾|sorry|notice:|we're sorry)|请(?:稍后|刷新|重试|检查网址|返回|更换)|稍后(?:再试|重试)|点击刷新|返回(?:首页|上一页)|刷新一下|请稍候|please try again|go back or search|\breload\b|验证码|人机验证|captcha|robot|no such item|异常|错误|\berror\b|超时|timed? ?out|loading|went wrong|under construction|coming soon|expired|log ?in again|sign in|try again|come back later|暂时|请(?:先)?登录|重新登录|人数过多|排队|升级|敬请期待|建设中|维护|出了点|出错|失败|不可用|^todo\b|^tbd\b|^fixme\b|write this|fill (?:this|in)|\bhere\]|^dear \[|尚未|待补|unavailable|not (?:available|found|exist)|overloaded|maintenance|unsupported|不支持")
# A sentence that speaks about such messages instead of being one.
_QUOTED = re.compile(r'"[^"]{2,80}"|「[^」]{2,80}」|《[^》]{2,80}》')
TALK = re.compile(r"改成更|\ba \d{3} [a-z ]{0,40}page\b|variable such as|template variable|模板变量|is filled in|字样|反面例子|写法|演示了|展示了|称为|当时只看到|的做法|showed that|known as|so-called|is called|was quoted|as an example")
#: A sentence of an article that speaks about notices of web pages.
TALK_OF_NOTICES = re.compile(r"这句话|的效力|措辞|改写.{0,12}提示|\breword\b|settles nothing")
LOREM = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua varius vitae nulla purus eros ornare felis tellus sapien augue turpis congue quam mollis urna porta luctus massa donec nunc morbi vestibulum pellentesque risus".split()
)
# Slots a template should have filled: named ones in any usual bracket, counted ones, and what formatting prints for nothing.
_NAMED = r"[a-z][a-z_.]{1,30}"
SLOT = re.compile(
    rf"\{{\{{\s*{_NAMED}\s*\}}\}}|[$#]\{{\s*{_NAMED}\s*\}}|<%=?\s*{_NAMED}\s*%>|\{{%\s*{_NAMED}\s*%\}}|\[\[\s*{_NAMED}\s*\]\]|(?<![\d%])%{_NAMED}%|__{_NAMED}__|(?<![\w{{$#])\{{(?:\d{{1,2}}|{_NAMED})\}}|@model\.[a-z]+|%[sd](?![a-z0-9])|\[object object\]|"
    r"[【\[](?:请(?:输入|填写)|此处(?:填写|插入|输入)|待(?:补充|填|定)|公司名称|产品型号|产品名称|作者姓名|数据来源待填|联系电话|insert|your|(?:first|last|full|user|company|author|product|customer) ?name|to be (?:added|filled))[^】\]]{0,16}[】\]]"
)
EMPTY_VALUE = re.compile(r"(?<![a-z])(?:null|undefined|nan|none|xxxx+)(?![a-z])")

#: Characters by which a leaf's density must exceed nothing to extend the body's span.
THRESHOLD = 12.0
_LEADING = re.compile(r"^(?:[一二三四五六七八九十]+|\d{1,2})\s*[、.,)]|^[(（]?(?:图|表|单位|注)|^(?:figure|table|unit|note)\b", re.I)
_EXPLAINING = re.compile(r"^[(（]?(?:图|表|单位|注|数据来源|资料来源)|^[(]?(?:figure|fig|table|units?|note|photo|chart|source)\b", re.I)
_SENTENCES = re.compile(r"(?<=[。!?])|(?<=[.!?]) ")
_HOLE = re.compile(r"@model|[{<\[【]|%[a-z]|__[a-z]|null|undefined|nan|none|xxxx")
_FILLER = re.compile(r"lorem|dolor|ipsum|purus|tellus|varius|测试|正文|内容|样例|示例|占位|说明|标题|段落|文字")
_STOCK = re.compile("副标题|标题占位|标题|这里是段落|段落文字|待编辑|请输入正文|正文内容|内容测试|测试一下|测试数据|测试内容|占位段|占位|示例文字|图片说明|样例句子|内容待更新|待更新|样例|正文|内容|测试|文字")

_BASE64 = re.compile(r"^[A-Za-z0-9+/_\-]{32,}={0,2}$")
_MOJIBAKE = re.compile("�|锟斤拷|烫烫|屯屯|Ã|Â|ï¼|â€|鐨勬|鎶|鍙戝|浜у|澧炲|杩|涓")
_SAME_MARKS = re.compile(r"([^\w\s])\1+")
_MARK = re.compile(r"[_^`|~@#{}<>=★☆◎▲△□■◆→←↑↓※°′¤]")
_SYMBOL = re.compile(r"[^\w\s]|_", re.UNICODE)
_COMMON_HAN = frozenset("的了在是和与将对为以及有不这从把被并而其中之前已")
_COMMON_LATIN = frozenset("the of and to in is a for on that it with as by at from was are its has have be or an this which than not more but".split())


@dataclass
class Line:
    number: int
    text: str
    kind: str = "blank"
    size: int = 0
    repeated: bool = False


@dataclass
class Page:
    lines: list[Line] = field(default_factory=list)
    kind: str | None = None
    body_size: int = 0
    slots: int = 0
    #: Lines that may be messages: (hash of the masked line, characters, weight of its phrases: PROOF or HINT).
    messages: list[tuple[int, int, int]] = field(default_factory=list)
    #: The hash of the whole masked body, if it has the shape of a message.
    whole: int | None = None
    by: dict[str, int] = field(default_factory=dict)

    def body(self) -> list[Line]:
        return [x for x in self.lines if x.kind in ("prose", "table", "list", "junk", "small")]

    def surroundings(self) -> list[int]:
        return [x.number for x in self.lines if x.kind in NOT_BODY]


#: A phrase that is proof by itself, and one that is so only of a line that recurs across sources.
PROOF, HINT = 2, 1
#: A body of the shape of a message: fewer characters and lines than this.
MESSAGE_LETTERS, MESSAGE_LINES = 240, 8

NOT_BODY = frozenset([*SURROUNDINGS, "menu", "footer", "heading", "item", "repeated"])


def plain_lines(content: str) -> list[str]:
    """The lines in NFKC, without invisible characters, with single blanks."""
    if not content.isascii():
        content = unicodedata.normalize("NFKC", content).replace("“", '"').replace("”", '"').replace("’", "'")
    if _NOISE.search(content):
        content = _NOISE.sub("", content)
    return [" ".join(line.split()) for line in content.split("\n")]


def words_of(text: str) -> tuple[int, int]:
    """(words, common words): a Han character is a word, as is a run of Latin letters."""
    han = _HAN.findall(text)
    latin = _LATIN_WORD.findall(text)
    return len(han) + len(latin), sum(c in _COMMON_HAN for c in han) + sum(w in _COMMON_LATIN for w in latin)


def tokens_of(text: str) -> list[str]:
    for two, one in _TWO_WORDS:
        if one[0] in text:
            text = two.sub(one, text)
    return [t for t in _SPLIT.split(text) if t]


def is_prose(lower: str) -> bool:
    """A sentence or more: it ends like one, and is long enough or has its share of function words."""
    if not _SENTENCE_END.search(lower) and not _INNER_END.search(lower):
        return False
    han = len(_HAN.findall(lower))
    if han >= 10 and lower.rstrip("\"')] ")[-1:] in "。.!?":
        return True
    words, common = words_of(lower)
    return words >= 6 and common >= max(1, words * 0.03)


def menu_kind(text: str) -> str | None:
    """menu or footer, of a line made of such words."""
    if len(text) > LONG and not _MENU_MARK.search(text):
        return None
    tokens = tokens_of(text)
    if not tokens or len(text) > 14 * len(tokens):
        return None
    menu, footer = sum(t in MENU_WORDS for t in tokens), sum(t in FOOTER_WORDS for t in tokens)
    named = menu + footer
    if named and named * 2 >= len(tokens) and (named > 1 or len(tokens) == 1):
        return "menu" if menu > footer else "footer"
    return None


def cells(text: str) -> list[str]:
    """The cells of a table row by the separator that cuts it best, else nothing."""
    for mark in ("\t", "|", ";", "　", "    ", ","):
        if text.count(mark) >= 2 or (mark in "\t|" and mark in text):
            found = [c.strip() for c in text.strip().strip("|").split(mark)]
            if len(found) > 2:
                return found
    return []


def body_kind(raw: str, text: str, lower: str) -> str:
    """prose, table, list, junk or small (a short line of an article), of a line that is no surrounding."""
    dense = text.replace(" ", "")
    size = len(dense)
    if size > 40 and text[-1] in "。.!?" and not _MOJIBAKE.search(raw) and raw.count("\t") < 2 and len(_MARK.findall(text)) * 8 < size:
        return "prose"
    if _BASE64.match(text) and any(c.isdigit() for c in text) and any(c.isupper() for c in text) and any(c.islower() for c in text):
        return "junk"
    bad = sum(len(m) for m in _MOJIBAKE.findall(raw))
    if bad * 4 >= size and bad >= 4:
        return "junk"
    row = cells(raw)
    if row:
        numbers = sum(bool(_NUMBER.match(unicodedata.normalize("NFKC", c))) or c in ("n/a", "-", "…", "", "—") for c in row)
        ruled = sum(set(c) <= set("-: ") for c in row)
        if (numbers * 2 >= len(row) and numbers) or ruled == len(row):
            return "table"
        if raw.count(",") + 1 == len(row) and not is_prose(lower) and numbers:
            return "table"
    symbols = len(_SYMBOL.findall(_SAME_MARKS.sub(r"\1", dense)))
    if symbols * 2 >= size and size >= 12 and not STRONG.search(lower):
        return "junk"
    if re.match(r"^[^:=。]{1,40}\d*\s*[:=]\s*[+\-]?\d[\d,.]*\s*[^\d\s]{0,8}$", text):
        return "table"
    if _is_spaced_noise(text, size) or _is_gibberish(text, lower) or _is_salad(lower):
        return "junk"
    if is_prose(lower):
        return "prose"
    return "list"


def _is_spaced_noise(text: str, size: int) -> bool:
    """Single characters set apart by marks."""
    if size < 20:
        return False
    marks = len(re.findall(r"[_^`]", text))
    return marks * 6 >= size


def _is_gibberish(text: str, lower: str) -> bool:
    """Runs of Latin letters that are no words: hardly a vowel, or marks and digits inside."""
    parts = text.split()
    if len(parts) < 5 or _HAN.search(text):
        return False
    odd = sum(bool(re.search(r"[a-z][|1I][a-z]|[|1I][|1I]|^[|1][a-z]|[a-z][|1]$|[a-z][I]|\d[a-z]\w*\d", p)) or (len(p) > 3 and p.isalpha() and len(re.findall("[aeiouy]", p.lower())) * 5 < len(p)) for p in parts)
    if any(w in _COMMON_LATIN for w in lower.split()) and odd * 2 < len(parts):
        return False
    return odd * 3 >= len(parts)


def _is_salad(lower: str) -> bool:
    """Few different terms strung together over and over, without punctuation."""
    if len(lower) < 60:
        return False
    parts = lower.split()
    if _HAN.search(lower):
        if len(parts) < 12:
            return False
        return len(set(parts)) * 2 <= len(parts)
    if len(parts) < 16 or re.search(r"[.!?,;:|/]", lower):
        return False
    pairs = list(zip(parts, parts[1:], strict=False))
    return len(set(parts)) * 2.5 <= len(parts) and len(set(pairs)) * 1.3 <= len(pairs)


_OBJECT = re.compile(
    r"(?:该|此|本|当前|您?(?:要|所)?(?:访问|请求|查看|查找)的)*(?:页面|栏目|资源|文章|内容|链接|网页|地址|服务|文档|稿件)|\b(?:the |this |your |that |requested )*(?:page|document|article|link|resource|service|server|portal|item|content|file|site)\b"
)


def mask(text: str) -> str:
    """A line with its numbers, dates, addresses, hexadecimal marks and the thing that it is about masked."""
    text = re.sub(r"https?://\S+|\b[\w.-]+@[\w.-]+\b|\bwww\.\S+|/[\w./-]+", "@", text.lower())
    return re.sub(r"[\W_]+", "", _OBJECT.sub("&", re.sub(r"\b(?=[0-9a-f]*\d)[0-9a-f]{4,}\b|\d+", "0", text)))


def masked_hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(mask(text).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def _is_chinese_filler(lower: str) -> bool:
    """Stock words of page tests, over and over."""
    han = "".join(_HAN.findall(lower))
    stock = sum(len(m) for m in _STOCK.findall(lower))
    if stock * 2 >= len(han) and stock >= 8:
        return True
    pairs = [han[i : i + 2] for i in range(len(han) - 1)]
    return len(pairs) >= 11 and len(set(pairs)) * 2 <= len(pairs) and len(lower.split()) <= 3


def _told(line: Line, kind: str, lower: str) -> int:
    """Characters of the line that are a message. Of a line of prose only the sentences that are one count: short, and not by what they quote."""
    if kind != "prose" or line.size <= 40:
        return line.size if STRONG.search(lower) and not _quoting(lower) else 0
    return sum(len(s.replace(" ", "")) for s in _SENTENCES.split(lower) if len(s) <= (60 if _HAN.search(s) else 120) and STRONG.search(s) and not _quoting(s))


def _quoting(sentence: str) -> bool:
    """The message stands in quotes within a longer sentence."""
    rest = _QUOTED.sub("", sentence)
    return sentence[0] not in "{<" and rest != sentence and len(rest) >= 8 and not STRONG.search(rest)


def look_for_messages(lines: list[Line], page: Page) -> None:
    """The parts of the body that are messages, filler or holed sentences. Longer lines are seen first; once those left can't be half of the body with what was found, none can make it a message any more, and none is looked for.

    A line that the site repeats is surroundings by that alone: it is body only as far as it is a message or filler, so that the most recurrent ones count.
    """
    slots = empties = 0
    whole = "\n".join(x.text for x in lines).lower()
    holed, stuffed = bool(_HOLE.search(whole)), bool(_FILLER.search(whole))
    open_ = sum(x.size for x in lines)  # what may still turn out to be messages
    for line in sorted(lines, key=lambda x: -x.size):
        lower = line.text.lower()
        again = line.kind == "repeated"
        kind = body_kind(line.text, line.text, lower) if again else line.kind
        if holed and kind != "junk" and _HOLE.search(lower):
            for sentence in _SENTENCES.split(lower):
                if not TALK.search(sentence):
                    slots += len(SLOT.findall(sentence))
                    empties += len(EMPTY_VALUE.findall(sentence))
        if stuffed and kind != "junk" and _FILLER.search(lower):
            words = _LATIN_WORD.findall(lower)
            if len(words) >= 4 and sum(w in LOREM for w in words) * 2 >= len(words) and not _HAN.search(lower) or _is_chinese_filler(lower):
                page.messages.append((masked_hash(line.text), line.size, PROOF))
                page.body_size += line.size * again
                continue
        if kind != "junk" and open_ * 2 >= page.body_size and not TALK.search(lower):
            if told := _told(line, kind, lower):
                page.messages.append((masked_hash(line.text), told, PROOF))
                page.body_size += line.size * again
                open_ -= line.size - told
                continue
            if (kind != "prose" or line.size <= 120) and WEAK.search(lower):
                page.messages.append((masked_hash(line.text), line.size, HINT))
                page.body_size += line.size * again
                continue
        open_ -= line.size
    page.slots = slots + (empties if slots or empties > 1 else 0)


def parse_page(content: str, repeated: frozenset[int] = frozenset(), numbers: dict[int, int] | None = None) -> Page:
    """The lines of a content with their classes. numbers: line number to line identifier; repeated: those its site repeats."""
    page = Page()
    in_list = False
    texts = plain_lines(content)
    lowers = [t.lower() for t in texts]
    starts = list(accumulate((len(t) + 1 for t in lowers), initial=0))
    hinted = {bisect_right(starts, end) - 1 for end in _trigger_ends("\n".join(lowers))}
    for number, raw in enumerate(content.split("\n"), 1):
        text, lower = texts[number - 1], lowers[number - 1]
        line = Line(number, text, size=len(text) - text.count(" "))
        page.lines.append(line)
        if not text:
            continue
        line.repeated = bool(numbers) and numbers.get(number) in repeated
        if number - 1 in hinted or line.repeated or len(text) <= 60 or text[-1] not in "。.!?":
            core = _EDGE.sub("", lower) or lower
            # a long line is known by how it begins
            look = _ANY_SURROUNDING.match if len(text) > LONG and not line.repeated else _ANY_SURROUNDING.search
            found = look(core) if number - 1 in hinted else None
            kind = found.lastgroup if found else menu_kind(core)
            if kind and ((kind == "crumb" and is_prose(core)) or TALK_OF_NOTICES.search(core) or (found and found.start() > 60 and is_prose(core))):
                kind = None
            if kind is None and len(core) <= 40 and _HEADING.match(core):
                kind = "heading"
            if kind is None and line.repeated and not _EXPLAINING.match(text):
                kind = "repeated"
            if kind:
                line.kind = kind
                in_list = kind == "heading" or (in_list and kind in ("neighbour", "advert"))
                continue
        line.kind = body_kind(raw, text, lower)
        if line.kind == "list" and in_list:
            line.kind = "item"
        elif line.kind == "prose":
            in_list = False
    settle(page)
    return page


def density(line: Line) -> float:
    """Composite text density of a leaf: characters outside links over tags, where a title or item counts as one link."""
    if line.kind in ("prose", "table"):
        return float(line.size)
    return 0.0


def body_span(lines: list[Line]) -> tuple[int, int]:
    """The run of lines, a subtree of the page's tree, with the largest sum of densities above THRESHOLD."""
    best, span, total, begin = 0.0, (0, 0), 0.0, 0
    for i, line in enumerate(lines):
        if line.kind in ("blank", "cookie", "share", "legal", "byline", "source"):
            continue
        if total <= 0:
            total, begin = 0.0, i
        total += density(line) - THRESHOLD
        if total > best:
            best, span = total, (begin, i + 1)
    return span


def cut_to_body(page: Page) -> None:
    """Titles and items outside the span of the body are surroundings, but for what leads into it or explains it."""
    begin, end = body_span(page.lines)
    lead = begin
    while lead > 0 and (page.lines[lead - 1].kind == "blank" or (page.lines[lead - 1].kind == "list" and _LEADING.match(page.lines[lead - 1].text))):
        lead -= 1
    for i, line in enumerate(page.lines):
        if line.kind == "list" and not lead <= i < end and not _EXPLAINING.match(line.text):
            line.kind = "item"


def settle(page: Page) -> None:
    """What the page's body is made of, by lines; and its messages."""
    body = page.body()
    page.body_size = sum(x.size for x in body)
    for x in body:
        page.by[x.kind] = page.by.get(x.kind, 0) + x.size
    shown = body + [x for x in page.lines if x.kind == "repeated"]
    look_for_messages(shown, page)
    if 0 < sum(x.size for x in shown) < MESSAGE_LETTERS and len(shown) <= MESSAGE_LINES:
        page.whole = masked_hash("\n".join(x.text for x in sorted(shown, key=lambda x: x.number)))


def measured_texts(page: Page) -> list[str]:
    """The texts of which repetition is measured: the body's prose together, and each long line else by itself, as items may be alike."""
    body = page.body()
    return ["\n".join(x.text for x in body if x.kind == "prose"), *(x.text for x in body if _is_long_item(x))]


def _is_long_item(line: Line) -> bool:
    return line.size >= 60 and (line.kind == "list" or (line.kind == "table" and not any(c.isdigit() for c in line.text)))


def decide(page: Page, repeated: list[float], statistics: dict[str, float] | None) -> None:
    """The page's kind, by what most of its body is and by its statistics.

    repeated: of each of measured_texts the share of its n-grams that repeat earlier ones; statistics: those of the whole body,
    which decide where prose is the most but not half of it.
    """
    size, by = sum(page.by.values()), page.by
    if not size:
        return
    kind = max(by, key=by.get)
    body = page.body()
    long = [x for x in body if _is_long_item(x)]
    seen: set[str] = set()
    again = by.get("prose", 0) * repeated[0]
    for x in body:  # short items that stand again
        if x.kind in ("list", "table") and x.text in seen and not (x.kind == "table" and any(c.isdigit() for c in x.text)):
            again += x.size
        seen.add(x.text)
    again += sum(x.size * r for x, r in zip(long, repeated[1:], strict=True))
    if kind != "junk" and size >= 60 and (by.get("junk", 0) + again) * 2 > size:
        page.kind = "junk"
    elif kind != "prose" and by[kind] * 2 > size and (len(body) > 2 or kind == "junk" or size > 60):
        page.kind = kind
    elif statistics and statistics["punctuated_lines"] < 0.3 and statistics["common_words"] < 0.03:
        page.kind = max((k for k in by if k != "prose"), key=by.get)
    elif kind == "prose":
        cut_to_body(page)


def read_pages(contents: list[str], repeated: list[frozenset[int]], numbers: list[dict[int, int] | None]) -> list[Page]:
    """Pages of several contents, their repetition and statistics measured together."""
    pages = [parse_page(*x) for x in zip(contents, repeated, numbers, strict=True)]
    open_ = [k for k, page in enumerate(pages) if page.by and max(page.by, key=page.by.get) == "prose" and page.by["prose"] * 2 <= sum(page.by.values())]
    wholes = measure(["\n".join(x.text for x in pages[k].body()) for k in open_], grams=False) if open_ else {}
    statistics = {k: {name: float(wholes[name][i]) for name in ("punctuated_lines", "common_words")} for i, k in enumerate(open_)}
    texts = [measured_texts(page) for page in pages]
    shares = iter(repeated_grams([t for several in texts for t in several]).tolist())
    for k, (page, several) in enumerate(zip(pages, texts, strict=True)):
        decide(page, [next(shares) for _ in several], statistics.get(k))
    return pages


def read_page(content: str, repeated: frozenset[int] | set[int] = frozenset(), numbers: dict[int, int] | None = None) -> Page:
    return read_pages([content], [frozenset(repeated)], [numbers])[0]
