"""The values of the SQL that checks the core queries, written out a second time so that a wrong word in either place shows."""

# Word lists, limits and labels.
LONG_TEXT = "正文过长需检查"
NOISE = ("请登录", "验证码", "扫码登录", "Access Denied", "403 Forbidden", "RSS")
NOISE_LABEL = "疑似噪音:"
NO_TITLE = "缺少标题"
SHORT_BY_SITE = {"CBNData": "CBNData详情页正文不可用或过短"}
SHORT_MATCH = "matched正文过短"
SHORT_PREVIEW = "公开预览内容过短"
BAD_HINTS = ("login", "register", "search", "rss", "english", "cart", "order", "about")
BLOCKED_MARKERS = ("验证码", "请登录", "請登入", "登录后", "扫码登录", "403 forbidden", "access denied", "captcha")
CLASS_WORDS = {
    "政策": ("政策", "通知", "公告", "规划", "条例", "办法", "意见"), "报告": ("报告", "白皮书", "研究", "研判", "调研"), "数据": ("数据", "统计", "指数", "规模", "同比", "环比"),
    "新闻": ("新闻", "动态", "发布", "召开", "调研"), "产业": ("产业", "行业", "市场", "企业", "链"),
}
COLUMN_WORDS = ("政策", "新闻", "动态", "数据", "统计", "发布", "公告", "通知", "报告", "研究", "解读", "产业", "行业", "专题")
GOOD_HINTS = ("news", "brief", "article", "industry", "research", "report", "channel", "information", "detail")
NO_COLUMN_WORDS = ("登录", "注册", "搜索", "邮箱", "订阅", "rss", "english", "新媒体", "信访", "智能问答", "无障碍", "地图", "关于我们")
SKIPPED_TEXT_PARTS = ("rss", "english", "新媒体", "信访", "智能问答", "无障碍", "登录", "注册", "搜索", "邮箱", "订阅", "可行性研究报告", "专精特新申报", "市场地位证明", "商业计划书", "定制报告", "提交需求")
SKIPPED_URL_PARTS = ("/znwd/", "/wzgl/", "/english/", "/rss", "/hd/xmt/", "login", "register", "search")
TRACKING_KEYS = ("spm", "from", "source")
TRACKING_PREFIX = "utm_"
