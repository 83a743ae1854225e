"""Patterns, word lists, limits and wording of the data model.

Everything here must equal the published behaviour for results to match.
Patterns are written for Java's regex engine; ``(?U)`` makes classes Unicode-aware.
"""

# Limits and windows.
PIECE_CHARS = 600
MODEL_BUDGET = 36_000
CHUNK_CHARS = 4_500
COMPARE_BUDGET = 16_000
COMPARE_MINIMUM = 80
KEY_SENTENCES = 6
FACT_CLUES = 8
BLOCK_SECONDS = 35
BLOCK_CHARS = 1_000
CAPTION_CHUNK_CHARS = 1_200
CAPTION_CHUNK_SECONDS = 105
CONTEXT_SECONDS = 8
CONTEXT_CAPTIONS = 10
MAX_FRAMES = 12
OCR_CONFIDENCE = 0.45

# Text units.
LINE_BREAK = r"\R|[\x1c-\x1e]"
LINK_ONLY = r"\A\[[^\]]+\]\([^)]+\)\z"
STAMP_LINK = r"(?U)https://www\.youtube\.com/watch\?v=[\w-]+&t=\d+s"
SENTENCE_BREAK = r"(?U)(?<=[。！？])|(?<=[.!?])[\s\x1c-\x1f]+"
# Both breaks in one pass; the blanks after a sentence stop at the end of its line.
ANY_BREAK = (
    r"(?U)\R|[\x1c-\x1e]|(?<=[。！？])"
    r"|(?<=[.!?])[[\s\x1f]&&[^\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]]+"
)
WATCH_PREFIX = "https://www.youtube.com/watch?v="
HTTP_LINK = r"\[([^\[\]]+)\]\(https?://[^)]+\)"
LETTERS_4 = r"(?:[A-Za-z一-鿿][^A-Za-z一-鿿]*){4}"
TOKEN = r"[a-z]{3,}|[一-鿿]{2}"
CUE = r"(?U)\d|重要|建議|注意|結論|截止|步驟"
FACT = (
    r"(?iu)(?U)\b\d{4}[-/]\d{1,2}|\d+(?:\.\d+)?\s*(?:%|元|萬|億|美元|天|小時)"
    r"|截止|報名|deadline|price|\$\d"
)
CITED_ID = r"(?U)\[(S\d+)\]"

# Captions.
CAPTION_LINE = (
    r"(?U)\A\[(\d+:\d+:\d+)\]\((https://www\.youtube\.com/watch\?v=[\w-]+&t=(\d+)s)\)\s*(.*)\z"
)
NOISE_CAPTIONS = ("[music]", "[applause]", "(笑", "（笑")
CLOSING_PROMO = (
    r"(?iu)訂閱|subscribe",
    r"(?iu)按讚|小鈴鐺|like and",
    r"(?iu)折扣碼|資訊欄.*連結",
    r"(?iu)參加.*挑戰",
    r"(?iu)秀出.*魅力",
)
CLOSING_PROMO_CHARS = 220
TRACK_LANGUAGES = ("zh-TW", "zh-Hant", "zh", "zh-CN", "zh-Hans", "en", "ja")
OTHER_LANGUAGE_RANK = 99

# Frames.
PROMO_FRAME = (
    r"(?iu)訂閱|按讚|小鈴鐺",
    r"(?iu)活動|挑戰",
    r"(?iu)開學季|優惠|折扣",
    r"(?iu)換你上場|參加",
)
OCR_NUMBER = r"(?U)\A[-+]?\d+(?:[.,]\d+)?%?\z"
OCR_LABEL = r"\A(?=.*[A-Za-z])[A-Za-z0-9]{2,8}\z"
OCR_STEP = r"\A[A-Z][A-Z0-9 _-]{1,23}\z"
CLAIMED_NUMBER = r"(?U)\d+(?:[.,]\d+)?%?"
LEAD_INS = ("畫面字幕顯示", "畫面顯示", "畫面中可見", "畫面可見", "可見")
SIMILARITY_LIMIT = 0.72

# Notes.
VAGUE_NOTE = (
    r"\A(?:這支)?(?:影片|作者|講者)(?:主要)?(?:介紹|分享|探討|討論|講解)"
    r".{0,20}(?:技巧|方法|內容|觀點|資訊|的重要性)[。.!！]?\z"
)
EMPTY_UNCERTAINTY = ("", "未提供", "無")

# Hosts of single-video links.
SHORT_HOSTS = ("youtu.be", "www.youtu.be")
VIDEO_HOSTS = (
    "youtube.com", "www.youtube.com", "m.youtube.com", "music.youtube.com",
    "youtube-nocookie.com", "www.youtube-nocookie.com",
)
VIDEO_ID = r"\A[A-Za-z0-9_-]{11}\z"

# Fetching.
TRANSIENT_STATUS = (408, 500, 502, 503, 504)
TRANSIENT_ERROR = r"(?i)timeout|timed out|net::err_connection"
STATUS_REASONS = {
    400: "模型或輸出格式不支援，請換用支援 JSON Schema 的文字模型",
    401: "API 金鑰無效",
    403: "帳號沒有此模型的存取權限",
    404: "找不到模型或 API",
    429: "API 額度不足或請求過於頻繁",
}
STATUS_REASON_OTHER = "AI 服務暫時無法使用（HTTP %d）"
CSV_HEADER = (
    "網址", "最終網址", "標題", "成功", "HTTP 狀態", "Markdown 檔案", "錯誤", "嘗試次數",
    "耗時秒", "擷取時間", "來源類型", "摘要方式", "摘要", "摘要提醒",
)

# Report wording.
MODE_PENDING = "尚未完成"
MODE_EXTRACT = "基本摘錄"
LABEL_FAILED = "失敗"
LABEL_RUNNING = "整理中"
LABEL_DONE = "完成"
NO_OUTLINE = "章節標題未通過檢查，請看下方已驗證引文的重點。"
NO_MORE_POINTS = "沒有額外可確認的重點。"
PARTS_HEAD = "## 各段重點（保留全文脈絡）"
PART_HEAD = "### 第 %d 段"
SUMMARY_HEAD = "## 重點摘錄（原文選句，非 AI 改寫）"
SUMMARY_EMPTY = "可用文字不足，無法產生可靠摘要。"
FACTS_HEAD = "## 數字／日期／條件線索（請核對原文）"
SOURCES_HEAD = "# 來源對照"
SOURCE_PREFIX = "來源："
COMPARE_SECTIONS = {
    "common": "共通點",
    "differences": "差異與不同條件",
    "unique": "個別來源重點",
}
COMPARE_EMPTY = "目前引用的內容不足以確認。"
DOCUMENT_LEAD = "文件 %d（%s）："
SECTION_DEFAULT = "摘要"
SLUG_DEFAULT = "research-report"
PAGE_DEFAULT = "page"
EXTRACT_TITLE = "字幕原句"
EXTRACT_TEXT = "字幕原句：「%s」"
FRAME_TITLE = "影格來源 "
LAYOUT_PAIRS_LEAD = "位置配對："
LAYOUT_ROWS_LEAD = "水平排列："
LAYOUT_SUFFIX = "（OCR 位置線索，需核對影格）"
NO_LAYOUT = "此影格尚無可靠的 AI 補充解讀，請直接核對圖片與字幕。"
