from lexmill.operators.canon_map import closest_entries
from lexmill.plans import canon

REGISTER = [(1, "윤슬해안 옥상텃밭의 설치 및 운영에 관한 법률", "윤슬해안텃밭법"), (2, "윤슬해안 옥상텃밭의 설치 및 운영에 관한 법률 시행령", None), (3, "바람분지·이동진료소 지원법", None), (4, "구름고원 CCTV관제소 관리법", None), (5, "구름습지 CCTV관제소 관리법", None)]
PARTS = "".join(chr(c) for c in (0x1107, 0x1161, 0x1105, 0x1161, 0x11B7))
CASES = {
    "「윤슬해안 옥상텃밭의 설치 및 운영에 관한 법률」": 1, "(구)윤슬해안 옥상텃밭의 설치 및 운영에 관한 법률 시행령": 2, "구 바람분지·이동진료소 지원법 제3조": 3, "윤슬해안텃밭법": 1,
    "윤슬헤안 옥상텃밭의 설치 및 운영에 관한 법률": 1, "윤슬안해 옥상텃밭의 설치 및 운영에관한법률 (법률 제123호)": 1, "윤슬해안 옥상텃밭의 설치 및 운영 법률 시행령": 2, "바람분지ㆍ이동진료소​ 지원法": 3, "바람분지,이동진료소 지원법.": 3,
    "구름고원 ССTV관제소 관리법": 4, "구름초지 CCTV관제소 관리법": 0, "구름과원 CCTV관제소 관리법": 4, "동법 시행령": 0, "별표 참조": 0, "": 0, "윤슬해안 옥상텃밭의 설치 및 운영에 관한 법률 시행규칙": 0,
    PARTS + "분지·이동진료소 지원법": 3,
}


def test_names(spark):
    names = spark.createDataFrame([(n,) for n in CASES], "value string")
    register = spark.createDataFrame(REGISTER, "reg_id int, official_name string, short_name string")
    out = dict(closest_entries(canon._readings(names), canon._entries(register), canon._places(register)).collect())
    assert {n: out.get(n, 0) for n in CASES} == CASES


def test_slips_count_and_other_edits_do_not(spark):
    text = "가나다라마바사아자차카타"
    typed = {"가나다라마바사아자차카": 1, "나가다라마바사아자차카타": 1, "갸나다라마바사아자차카타": 1, "가나다라마바사자아차타카": 1, "가가나다라마바사아자차카": 1, "가나다라마바사아자차카풍": 0, "흥나다라마바사아자차카타": 0, "전혀다른이름입니다정말로": 0}
    entries = spark.createDataFrame([(1, text)], "entry_id int, text string")
    out = dict(closest_entries(spark.createDataFrame([(t, t) for t in typed], "value string, reading string"), entries).collect())
    assert {t: out.get(t, 0) for t in typed} == typed


def test_empty(spark):
    none = spark.createDataFrame([], "value string, reading string")
    entries = spark.createDataFrame([(1, "가나다라마바사")], "entry_id int, text string")
    assert closest_entries(none, entries).count() == 0
    assert closest_entries(spark.createDataFrame([("a", "가나다라마바")], "value string, reading string"), entries.limit(0)).count() == 0


def test_another_place_of_the_list_is_another_name(spark):
    register = spark.createDataFrame(REGISTER[:1] + [(4, "구름고원 CCTV관제소 관리법", None), (6, "새벽과원 쉼터 관리법", None)], "reg_id int, official_name string, short_name string")
    names = spark.createDataFrame([("구름과원 CCTV관제소 관리법",)], "value string")
    assert closest_entries(canon._readings(names), canon._entries(register), canon._places(register)).count() == 0
