from kinforge.sources import charsets, ged


def head(name):
    return f"0 HEAD\n1 CHAR {name}\n".encode()


def test_rare_header_names():
    assert "Müller" in ged.decode(head("IBM-PC") + "1 NAME Müller\n".encode("cp437"))
    assert "Müller" in ged.decode(head("MAC") + "1 NAME Müller\n".encode("mac_roman"))
    assert "Иван" in ged.decode(head("windows-1251") + "1 NAME Иван\n".encode("cp1251"))


def test_ansel_and_headers_that_lie():
    assert "1 NAME Žiga Łé" in ged.decode(head("ANSEL") + b"1 NAME \xe9Ziga \xa1\xe2e\n")
    assert "1 NAME Miloš" in ged.decode(head("ANSEL") + "1 NAME Miloš\n".encode("cp1250"))


def test_prefix_letters():
    body = b"1 NAME KovaA\xa8i\x41\xa8\n" * 30 + b"1 NAME A\xa0tef \xc23\n1 NOTE plain A text\n"
    text = ged.decode(head("UTF-8") + body)
    assert "1 NAME Kovačič" in text and "Štef ł" in text and "plain A text" in text
    assert not charsets.has_prefix_letters(body, "ANSI")


def test_bytes_decide_where_the_header_does_not():
    assert "München" in ged.decode(head("ANSI") + b"1 PLAC M\x81nchen, \x9aola, \xe8as\n")
    russian = "1 NAME Анна Петрова Иванова Сергеева\n".encode("cp1251") * 3
    assert "Петрова" in ged.decode(head("ANSI") + russian)
    assert "señor Håkon Bjørn à côté" in ged.decode(head("ANSI") + "1 NAME señor Håkon Bjørn à côté\n".encode("cp1252"))
    assert "Đurđa" in ged.decode(head("ANSI") + "1 NAME Đurđa Tomić\n".encode("cp1250"))


def test_nul_return_and_cut_signs():
    assert ged.decode(b"0 HEAD\r1 NAME A\0na\r") == "0 HEAD\n1 NAME Ana\n"
    assert "1 NOTE a€b" in ged.decode(head("UTF-8") + b"1 NOTE a\xe2\x82\r\n2 CONC \xacb\r\n")
    assert ged.decode("0 HEAD\n1 NAME A\0na\n".encode("utf-16")) == "0 HEAD\n1 NAME Ana\n"
    assert ged.decode(b"0 HEAD\n1 CHAR UTF-8\n1 NOTE x \xff y\n").count("�") == 1
