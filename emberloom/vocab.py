"""Vocabularies that results depend on."""

# Place names, in the order in which they are looked for.
PREFECTURES = "北海道 青森県 岩手県 宮城県 秋田県 山形県 福島県 茨城県 栃木県 群馬県 埼玉県 千葉県 東京都 神奈川県 新潟県 富山県 石川県 福井県 山梨県 長野県 岐阜県 静岡県 愛知県 三重県 滋賀県 京都府 大阪府 兵庫県 奈良県 和歌山県 鳥取県 島根県 岡山県 広島県 山口県 徳島県 香川県 愛媛県 高知県 福岡県 佐賀県 長崎県 熊本県 大分県 宮崎県 鹿児島県 沖縄県".split()
OLD_PROVINCES = "陸奥国 出羽国 常陸国 下総国 上総国 安房国 武蔵国 相模国 甲斐国 信濃国 越後国 越中国 能登国 加賀国 越前国 美濃国 飛騨国 遠江国 駿河国 伊豆国 伊勢国 近江国 山城国 大和国 河内国 和泉国 摂津国 紀伊国 丹波国 丹後国 但馬国 因幡国 伯耆国 出雲国 備前国 備中国 備後国 安芸国 周防国 長門国 阿波国 讃岐国 伊予国 土佐国 筑前国 筑後国 豊前国 豊後国 肥前国 肥後国 日向国 大隅国 薩摩国 琉球国".split()
NOWHERE = "日本各地"

# Regions and their prefectures.
REGIONS = {
    "北海道": ["北海道"],
    "東北": ["青森県", "岩手県", "宮城県", "秋田県", "山形県", "福島県"],
    "関東": ["茨城県", "栃木県", "群馬県", "埼玉県", "千葉県", "東京都", "神奈川県"],
    "中部": ["新潟県", "富山県", "石川県", "福井県", "山梨県", "長野県", "岐阜県", "静岡県", "愛知県"],
    "近畿": ["三重県", "滋賀県", "京都府", "大阪府", "兵庫県", "奈良県", "和歌山県"],
    "中国": ["鳥取県", "島根県", "岡山県", "広島県", "山口県"],
    "四国": ["徳島県", "香川県", "愛媛県", "高知県"],
    "九州沖縄": ["福岡県", "佐賀県", "長崎県", "熊本県", "大分県", "宮崎県", "鹿児島県", "沖縄県"],
}

# Phenomenon types by priority and the keywords that name them.
PHENOMENA = {
    "死霊": "死 霊 幽 亡 墓 供養 祟 呪 怨 成仏 骸 骨".split(),
    "音声": "音 声 鳴 叫 泣 啼 笑 歌 囁 唸 吠 鳴く".split(),
    "変化": "化け 変化 化す 姿を変 正体 変身 狐 狸 人に化".split(),
    "水界": "水 海 川 池 沼 湖 滝 浜 磯 淵 河 舟 船".split(),
    "山野": "山 森 林 峠 谷 野 原 岩 石 洞 穴".split(),
    "追跡": "追 送 連れ 付いて 後をつけ 迷 誘 惑わ 道に迷".split(),
    "視覚": "光 火 影 見え 現れ 消え 燃 灯 炎 輝".split(),
    "接触": "触 掴 叩 投げ 引 押 噛 絞 襲 打 殴".split(),
}

# Name endings and their categories.
SUFFIXES = {
    "坊主": "人型・僧", "入道": "人型・僧", "小僧": "人型・児", "太郎": "人型・男", "次郎": "人型・男", "法師": "人型・僧",
    "童子": "人型・児", "女房": "人型・女", "姫": "人型・女", "婆": "人型・老女", "爺": "人型・老男", "女": "人型・女",
    "男": "人型・男", "娘": "人型・女", "童": "人型・児", "丸": "船/名", "彦": "人型・男",
    "天狗": "超自然・天狗", "鬼": "超自然・鬼", "神": "超自然・神", "仏": "超自然・仏", "精": "超自然・精霊", "魂": "超自然・魂", "霊": "超自然・霊", "魔": "超自然・魔",
    "化け": "変化", "お化け": "変化", "おばけ": "変化", "変化": "変化", "化け猫": "変化・猫",
    "火": "現象・火", "灯": "現象・火", "炎": "現象・火",
    "狐": "動物・狐", "狸": "動物・狸", "猫": "動物・猫", "犬": "動物・犬", "蛇": "動物・蛇", "鳥": "動物・鳥", "蜘蛛": "動物・蜘蛛", "蟹": "動物・蟹", "鯨": "動物・鯨", "馬": "動物・馬", "虎": "動物・虎", "龍": "動物・龍", "竜": "動物・龍",
    "首": "身体・首", "目": "身体・目", "手": "身体・手", "足": "身体・足", "顔": "身体・顔", "頭": "身体・頭", "舌": "身体・舌", "骨": "身体・骨",
}

# Name beginnings and their categories.
PREFIXES = {
    "海": "場所・海", "山": "場所・山", "川": "場所・川", "河": "場所・川", "池": "場所・池", "沼": "場所・沼", "磯": "場所・磯", "橋": "場所・橋", "道": "場所・道", "野": "場所・野", "森": "場所・森", "井": "場所・井戸", "天": "場所・天", "地": "場所・地",
    "夜": "時間・夜", "朝": "時間・朝", "夕": "時間・夕",
    "赤": "色・赤", "青": "色・青", "白": "色・白", "黒": "色・黒", "金": "色・金",
    "大": "サイズ・大", "小": "サイズ・小", "一": "数・一", "百": "数・百", "千": "数・千",
    "古": "状態・古", "送り": "行為・送り", "隠": "行為・隠", "飛": "行為・飛", "泣": "行為・泣",
}

# Labels of survey answers.
PERCEPTION_LABELS = {"character": "キャラクター", "culture": "歴史・文化", "psychology": "心理・現象", "none": "とくにない"}
PERCEPTIONS = ["character", "scary", "culture", "psychology", "spiritual", "none"]
SELECTION_LABELS = {
    "A": "C1 (Character Consumption)",
    "B": "C2 (Technology Focus)",
    "C": "C3 (Cultural Anchoring)",
    "D": "C2-variant (Tourism/PR)",
    "E": "C4 (Anxiety Externalization)",
    "F": "C5 (Ephemeral Reflection)",
    "G": "Unclear",
}
