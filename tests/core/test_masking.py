import json

import pytest
from pyspark.sql import functions as F

from tidewell.functions import masking as m

# Nothing here is a secret: the values are put together so that no scanner takes them for one.
PW = "-".join(["mulch", "9", "Fern", "77", "kettle"])
TOKEN = "gho_" + "Garden" * 4
TEXTS = [
    (f"deploy with key {'sk-' + 'Compost' * 4} today", "deploy with key [MASKED] today"),
    (f"use {TOKEN} once", "use [MASKED] once"),
    (f'export DB_PASSWORD="{PW}"', 'export DB_PASSWORD="[MASKED]"'),
    (f"connecting\npassword={PW}\ndone\n", "connecting\npassword=[MASKED]\ndone\n"),
    (f"api_key: {PW} rest", "api_key: [MASKED] rest"),
    (f'{{"user": "bob", "password": "{PW}"}}', '{"user": "bob", "password": "[MASKED]"}'),
    (f"{{'api_key': '{PW}'}}", "{'api_key': '[MASKED]'}"),
    (f"login --password {PW} -v", "login --password [MASKED] -v"),
    (f"PGPASSWORD={PW} psql -h x", "PGPASSWORD=[MASKED] psql -h x"),
    (f"sshpass -p {PW} ssh x", "sshpass -p [MASKED] ssh x"),
    (f"mysql -u root -p{PW} db", "mysql -u root -p[MASKED] db"),
    (f"curl -u bob:{PW} http://x", "curl -u bob:[MASKED] http://x"),
    (f"echo {PW} | sudo -S ls", "echo [MASKED] | sudo -S ls"),
    ("password = get_password()", "password = [MASKED]"),
    ("nothing to hide here", "nothing to hide here"),
    ("password=$DB_PASSWORD", "password=$DB_PASSWORD"),
    ("", ""),
]


@pytest.mark.parametrize("text, masked", TEXTS)
def test_flat_patterns(text, masked):
    assert m.clean(text, []) == masked


def test_columns_mask_alike(spark):
    df = spark.createDataFrame([*TEXTS, (None, None)], "text string, want string")
    for r in df.select("want", m.mask(F.col("text")).alias("got")).collect():
        assert r["got"] == r["want"]


#: Field names whose last word is a credential, in the ways in which names are written.
SECRET_FIELDS = ["password", "PGPASSWORD", "SSHPASS", "db_pass", "pw", "passphrase", "Authorization", "api_key", "token", "apiKey", "client_secret", "access-token", "privateKey", "accessToken", "store_secret_access_key", "credentials"]
#: Field names that only mention one, and values that are references, placeholders or no credential.
PLAIN_FIELDS = {"key": "beds/north.md", "sort_key": "name_desc", "auth": "basic", "token_count": "12", "token_type": "opaque", "password_policy": "twelve signs", "passage": "gate", "token_ref": "x", "boarding": "pier 2", "sort_keys": "n", "keys": "two", "api_key_hint": "blue", "password_hint": ""}


@pytest.mark.parametrize("value", [PW, "1234", "three plain words", "$ign$ inside"])
def test_record_fields(value):
    fields = dict.fromkeys(SECRET_FIELDS, value)
    assert m.clean_record(fields, None, []) == dict.fromkeys(fields, m.MARK)
    assert m.clean_record({"pin_passwords": 4321, "access_tokens": 5, "secret": 0.5}, None, []) == dict.fromkeys(["pin_passwords", "access_tokens", "secret"], m.MARK)


def test_fields_that_stay():
    assert m.clean_record(PLAIN_FIELDS, None, []) == PLAIN_FIELDS
    kept = {"max_tokens": 512, "tokens": 3, "pwd": True, "client_secret2": None, "access_token": "${GARDEN_TOKEN}", "db_password": " $GARDEN_PW\n", "secret": "None", "client_secret": "<put it here>", "password": None}
    assert m.clean_record(kept, None, []) == kept


def test_a_credential_name_carries_down():
    """Everything below a credential's name is masked, whatever it is called; plain names and references are not."""
    got = m.clean_record({"passwords": {"shed": PW, "gate": 990011}, "sheds": {"credentials": [{"name": "ida", "port": 8080}]}, "api_keys": [PW, "y"]}, None, [])
    assert got == {"passwords": {"shed": m.MARK, "gate": m.MARK}, "sheds": {"credentials": [{"name": m.MARK, "port": m.MARK}]}, "api_keys": [m.MARK, m.MARK]}
    plain = {"secret": {"value": "$GARDEN_PW"}, "tokens": {"input": 7}, "usage": {"output_tokens": 8}, "beds": {"rows": 3, "label": "north side"}}
    assert m.clean_record(plain, None, []) == plain


def test_metadata_stays_json():
    class Opaque:
        def __str__(self):
            return f"line\npassword={PW}"

    got = m.clean_metadata({"cmd": f'export DB_PASSWORD="{PW}"', "object": Opaque(), TOKEN: "a key", "count": 3})
    assert PW not in got and TOKEN not in got and json.loads(got)["count"] == 3


def test_values_of_the_environment_file(tmp_path, monkeypatch):
    env = tmp_path / "secrets.env"
    env.write_text(f"# x\nDB_PASSWORD={PW}\nexport OTHER='quoted value'\n")
    monkeypatch.setenv(m.ENV_FILE_VARIABLE, str(env))
    assert m.clean(f"value {PW} and quoted value") == "value [MASKED] and [MASKED]"
    env.unlink()
    with pytest.raises(OSError):
        m.clean("x")


def test_a_secret_cut_by_the_tail_is_masked_before_the_cut(spark):
    text = "x" * 5000 + "\npassword=" + PW + "\n" + "." * 1992
    got = spark.createDataFrame([(text,)], "t string").select(m.masked_tail(F.col("t"))).first()[0]
    assert PW[-7:] not in got and len(got) == 2000
