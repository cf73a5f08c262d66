"""Packages of results: archive, checksum document and run metadata. These are a few small files, made on the driver after the batch writes."""

from __future__ import annotations

import hashlib
import os
import shutil
import tarfile
import xml.etree.ElementTree as ET


def rewrite(template: str, target: str, changes: dict[str, dict[str, str]]) -> None:
    """A copy of an XML file with attributes of the first element of each tag set; tags that it lacks are left out."""
    tree = ET.parse(template)
    for tag, attributes in changes.items():
        element = tree.getroot() if tree.getroot().tag == tag else tree.getroot().find(f".//{tag}")
        if element is not None:
            for name, value in attributes.items():
                element.set(name, value)
    tree.write(target, encoding="utf-8", xml_declaration=True)


def archive(folder: str, target: str) -> str:
    """folder as a tar file; returns its SHA-1."""
    with tarfile.open(target, "w") as tar:
        tar.add(folder, arcname=os.path.basename(folder.rstrip("/")))
    return sha1(target)


def sha1(path: str) -> str:
    digest = hashlib.sha1()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            digest.update(block)
    return digest.hexdigest()


def checksum_document(name: str, digest: str, target: str, fixed: dict[str, str] | None = None) -> None:
    """An XML file with the archive's name, its SHA-1 and what else is to stand there."""
    root = ET.Element("checksum")
    for tag, value in {"file": name, "sha1": digest, **(fixed or {})}.items():
        ET.SubElement(root, tag).text = value
    ET.ElementTree(root).write(target, encoding="utf-8", xml_declaration=True)


def publish(folder: str, work: str, target: str, fixed: dict[str, str] | None = None) -> str:
    """Archive a folder, copy the archive and then its checksum document to target, so a reader that sees the document finds the archive whole."""
    os.makedirs(target, exist_ok=True)
    name = os.path.basename(folder.rstrip("/")) + ".tar"
    digest = archive(folder, os.path.join(work, name))
    document = os.path.join(work, name.removesuffix(".tar") + ".xml")
    checksum_document(name, digest, document, fixed)
    for path in (os.path.join(work, name), document):
        shutil.copy(path, target)
    return digest
