"""Vocabularies and limits that decide results. All are parameters; these are the defaults."""

from __future__ import annotations

# Characters that a comparison key leaves out.
BRACKETS = "『』「」【】《》〈〉[]()（）"
SEPARATORS = "・･:：;；,，、/／\\|｜-‐‑‒–—―ー~〜～_＿ 　\t"

# Outlet names that end a title after a dash or bar.
OUTLETS = ["コミックナタリー", "アニメイトタイムズ", "映画\\.com", "アニメ！アニメ！", "MOVIE\\s*WALKER\\s*PRESS", "リスアニ！", "ファミ通\\.com", "マイナビニュース", "ORICON\\s*NEWS", "音楽ナタリー", "映画ナタリー"]

# Prefixes of a work's title that a loose key leaves out; the first that fits goes.
LOOSE_PREFIXES = ["劇場版総集編", "劇場版", "劇場アニメ", "アニメ映画", "tvアニメ", "テレビアニメ", "アニメ", "映画"]

# Words of the event categories, in order of the categories.
CATEGORY_WORDS = {
    "revival": ["リバイバル上映", "リバイバル", "再上映", "復活上映", "復刻上映", "アンコール上映", "4kリマスター", "リマスター版", "リマスター上映", "期間限定上映", "特別上映", "凱旋上映", "再映", "周年記念上映", "記念上映", "デジタルリマスター"],
    "screening_event": ["舞台挨拶", "応援上映", "爆音上映", "絶叫上映", "発声可能上映", "ライブ上映", "先行上映", "トークショー", "トークイベント", "見逃し上映", "同時上映", "プレミア上映", "完成披露", "上映会", "特典上映"],
    "exhibition": ["原画展", "展示会", "展覧会", "企画展", "設定資料展", "コラボカフェ", "コラボレーションカフェ", "ポップアップストア", "ポップアップショップ", "期間限定ショップ", "常設展", "ミュージアム", "アニメ展", "作品展", "巡回展", "展の開催", "展が開催", "展を開催", "展開催", "展の詳細"],
    "goods": ["グッズ", "受注生産", "予約受付", "予約開始", "通販", "フィギュア", "プラモデル", "ガンプラ", "ねんどろいど", "アクリルスタンド", "アクスタ", "缶バッジ", "一番くじ", "blu-ray", "dvd", "円盤", "box", "サウンドトラック", "サントラ", "復刻版", "限定商品", "コラボ商品", "新商品", "発売決定", "発売開始"],
    "concert": ["オーケストラコンサート", "オーケストラ", "交響", "シンフォニー", "コンサート", "単独公演", "ライブイベント", "音楽祭", "スペシャルライブ", "アニsoン", "ライブツアー", "フェス出演", "生演奏上映", "シネマコンサート"],
}
EXCLUDED_WORDS = ["配信開始", "配信決定", "配信情報", "ゲーム化", "アプリ配信", "声優 誕生日", "ランキング発表"]
HINT_WORDS = ["決定", "開催", "実施", "限定", "追加", "チケット", "受付", "発売"]
HINT_STEM = "上映"

# Characters before and after 展 that make it another word.
EXHIBITION_NOT_AFTER, EXHIBITION_NOT_BEFORE = "発進親伸", "開望示覧"

# Words that any title may have.
GENERIC_TERMS = [
    "展覧会", "展示", "開催", "決定", "上映", "公開", "記念", "全国", "劇場", "映画", "作品", "情報", "実施", "予定", "限定", "発表", "開始", "実行",
    "イベント", "アニメ", "アニメーション", "監督", "原作", "出演", "登壇", "販売", "発売", "商品", "版", "周年", "今年", "来年", "本日", "以降",
    "コメント", "到着", "解禁", "公式", "サイト", "ニュース", "特集", "チケット", "受付", "前売", "当日", "会場", "会期", "詳細",
]
TERM_PATTERN = "[一-龥]{2,}|[ァ-ヴー]{3,}|[A-Za-z]{3,}"

# Limits.
SIMILAR_TITLES, SHARED_TERMS, QUOTED_LEAST = 0.45, 2, 6
MOST_AGE_DAYS, MOST_LEAD_DAYS, MOST_BACK_DAYS, INFER_DAYS, RETENTION_DAYS = 180, 550, 31, 300, 240
SPAN_DAYS = {"revival": 60, "screening_event": 60, "concert": 31, "goods": 31, "exhibition": 210}
SPAN_DEFAULT = 210

# Display texts.
CATEGORY_NAMES = {"revival": "リバイバル上映", "screening_event": "上映イベント", "exhibition": "展示・コラボ", "concert": "ライブ・コンサート", "goods": "グッズ・商品"}
STATUS_NAMES = {"new": "NEW", "updated": "日程判明"}

# Query templates, {term} standing for a name.
PERSON_FIRST, PERSON_LAST = "{term} イベント 上映 決定", "{term} 展示会 トークショー 登壇"
WORK_TEMPLATES = ["{term} リバイバル上映", "{term} 上映 イベント 決定", "{term} 展示会 原画展 コンサート", "{term} グッズ 発売 予約受付"]
VENUE_QUERIES = ["新文芸坐 特集上映 スケジュール アニメ", "塚口サンサン劇場 上映作品 アニメ", "早稲田松竹 特集上映", "シネマート新宿 アニメ 特集上映", "Filmarks リバイバル上映プロジェクト 新着", "午前十時の映画祭 アニメ ラインナップ", "4Kリマスター 劇場公開 決定 アニメ", "35mmフィルム 上映 アニメ 特集"]
BROAD_QUERIES = ["アニメ リバイバル上映 決定", "劇場アニメ 応援上映 爆音上映 決定", "アニメ 原画展 開催 決定"]
POST_WORK, POST_PERSON, POST_ACCOUNT = "{term} リバイバル上映 OR 上映決定 OR 舞台挨拶", "{term} 上映 OR イベント OR 展", "from:{term} 上映"
ACCOUNTS = ["Filmarks_ticket", "toho_movie", "shin_bungeiza", "sunsun3_gekijo"]

# Reasons for which a date isn't announced; {0} and {1} stand for numbers.
REASON_NO_DATE = "日付が読み取れない"
REASON_SPAN = "会期が{0}日と長すぎる（この種別の上限{1}日）。掲載期間や年度表示を拾った疑い"
REASON_NO_YEAR = "記事の公開日が不明で、出典にも年の記載がない"
REASON_OLD = "記事が古い（{0}日前）"
REASON_BEFORE = "記事の公開日より前の日付（過去の出来事への言及）"
REASON_AFTER = "記事の公開日から離れすぎている（年の取り違えの疑い）"
NOTE_NO_YEAR = "出典に年の記載がなく、記事の公開日も不明"
NOTE_MONTH = "出典に月までしか書かれていない（日は未発表）"

# Notes on article bodies; {0} stands for a text.
BODY_BLOCKED = "本文を取得できない（ネットワークポリシーで遮断）"
BODY_FAILED = "本文を取得できない（{0}）"
BODY_CORRECTED = "本文により {0} から訂正"
BODY_CONFIRMED = "本文で確認"
BODY_CONTRADICTED = "本文と一致しない"
BODY_NO_YEAR = "本文に同じ月日はあるが、年の記載なし"
BODY_NO_DATE = "本文に日付の記載なし"
BODY_DATE_NOTE = "本文に該当する日付が見当たらない"

# Texts of digests and mails; {0} and {1} stand for numbers or texts.
PERIOD_UNSURE, PERIOD_OPEN, PERIOD_JOINER = "日程未確認", "日程未定", "〜"
BULLET_HEAD, BULLET_MORE, PUSH_MORE = "新着{0}件", "- ほか{0}件", "ほか{0}件"
MAIL_SUBJECT = "{0} 新着{1}件（ウォッチ対象{2}件）"
MAIL_NOTHING, MAIL_INTRO = "新着はありませんでした。", "{0} 時点の新着イベント情報です。"
MAIL_NOTE, MAIL_HINT, MAIL_NO_HINT = "   ※ 日程は載せていません（{0}）: {1}", "「{0}」とあるが未確認", "日付なし"
MAIL_OUTRO = "※ うち{0}件は日程を載せていません。出典に年の記載が無いなど、裏の取れない日付は誤りのもとなので出さない方針です。判明した回に再通知します。"
